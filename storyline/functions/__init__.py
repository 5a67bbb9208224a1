"""Column functions: text cleaning, dates, links, vectors."""
