"""One query per operator over the given tables. Values are rounded and dates are text, for the SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import tables as B
from bindings.landing import land_entries, land_episodes
from storyline.functions import dates as D
from storyline.functions import links as L
from storyline.functions import text as X
from storyline.functions import vectors as V
from storyline.operators import agreement as G
from storyline.operators import clustering as C
from storyline.operators import embed as E
from storyline.operators import ingest as I
from storyline.operators import stories as S
from storyline.operators.ordering import positions
from storyline.plans import catalog, digests, evaluation, models, views
from storyline.plans.analysis import daily_analysis as analyze_day
from storyline.schema import ISSUE
from storyline.session import materialize, new_path
from storyline.sources import articles as A
from storyline.sources import episodes as P
from storyline.sources import feeds as R
from storyline.streaming.ingest import collect_entries, collected_articles, collected_entries, start_ingest, stream_articles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Distance below which the given vectors count as near.
NEAR = 0.80
GRID = evaluation.threshold_grid(0.60, 0.90, 0.05)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def day(column: str = "issue_date") -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def issue() -> list[Column]:
    """The issue columns; ``show`` is a keyword in the checking SQL."""
    return [F.col("show").alias("programme"), day()]


def stamp(column: str, name: str | None = None) -> Column:
    return F.coalesce(F.date_format(column, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(name or column)


def six(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    rounded = F.round(value, 6)
    return rounded.alias(column) if isinstance(column, str) else rounded


# Sources and sinks


@query
def rss_scan(spark, sf_dir):
    path = new_path(spark, "landing")
    R.write_rss(B.document_entries(spark, sf_dir), path)
    texts = ("title", "published", "description", "summary", "author", "link")
    placed = positions(R.read_rss(spark, path), [], [F.col("seq")], "place")
    return placed.select("feed_id", "place", *[F.coalesce(X.strip(F.col(c)), F.lit("")).alias(c) for c in texts])


def _entries_read(spark, path) -> DataFrame:
    texts = ("title", "published", "summary", "author", "link")
    placed = positions(R.read_rss(spark, path), [], [F.col("seq")], "place")
    return placed.select("feed_id", "place", *[F.coalesce(X.strip(F.col(c)), F.lit("")).alias(c) for c in texts])


@query
def atom_scan(spark, sf_dir):
    """Every second feed is landed as Atom, the others as RSS; one scan reads both."""
    path = new_path(spark, "landing")
    entries, second = B.document_entries(spark, sf_dir), F.substr("feed_id", F.lit(4)).cast("int") % 2 == 1
    R.write_rss(entries.filter(~second), path)
    R.write_atom(entries.filter(second), path)
    return _entries_read(spark, path)


@query
def rss_rejects(spark, sf_dir):
    """The audit of a landing where every third feed also has a file with a broken item, and every fifth one that is no feed."""
    path = new_path(spark, "landing")
    entries = B.document_entries(spark, sf_dir)
    R.write_rss(entries, path)
    number = F.substr("feed_id", F.lit(4)).cast("int")
    feeds = entries.select("feed_id").distinct()
    item = F.lit("<rss><channel><item><title>kept</title></item><item><title>lost</titel></item></channel></rss>")
    for kind, body in ((3, item), (5, F.lit("no feed"))):
        feeds.filter(number % kind == 0).select("feed_id", body.alias("value")).write.mode("append").partitionBy("feed_id").text(path)
    found = R.audit_feeds(spark, path)
    return found.select("feed_id", "broken_files", "empty_files", "items", "untitled_items")


@query
def feed_dim(spark, sf_dir):
    rows = R.feed_dim(B.feeds(spark, sf_dir))
    return rows.select(*[F.coalesce(F.col(c), F.lit("-")).alias(c) for c in rows.columns])


@query
def articles_scan(spark, sf_dir):
    path = new_path(spark, "articles")
    A.write_articles(B.articles(spark, sf_dir).drop(*A.ARTICLE_DEFAULTS), path)
    return A.read_articles(spark, path).select("seq", "source", "title", *A.ARTICLE_DEFAULTS)


@query
def articles_roundtrip(spark, sf_dir):
    path = new_path(spark, "articles")
    A.write_articles(B.articles(spark, sf_dir), path)
    return A.read_articles(spark, path).select(
        "source", "date", "title", "country", "description", "author", "link", stamp("published"), "seq", *issue()
    )


def _halves(rows: DataFrame) -> DataFrame:
    """The issues an earlier run has stored: those of odd days."""
    return rows.filter(F.dayofmonth("issue_date") % 2 == 1)


@query
def incremental_issues(spark, sf_dir):
    path = new_path(spark, "articles")
    incoming = B.articles(spark, sf_dir)
    A.write_articles(_halves(incoming), path)
    fresh = A.new_issues(incoming, A.read_articles(spark, path))
    return fresh.select("seq", "source", "title", day())


@query
def embed_incremental(spark, sf_dir):
    path = new_path(spark, "embeddings")
    rows = B.articles(spark, sf_dir)
    A.write_embeddings(E.embed(_halves(rows), "letters"), path)
    missing = A.not_embedded(rows, A.read_embeddings(spark, path, "letters"))
    A.write_embeddings(E.embed(missing, "Letters"), path)
    return A.read_embeddings(spark, path, "LETTERS").select("seq", "embedding_text", _letters().alias("vector"))


def _letters() -> Column:
    return F.concat_ws(",", F.transform("embedding", lambda x: x.cast("int").cast("string")))


@query
def episode_scan(spark, sf_dir):
    root = new_path(spark, "artifacts")
    land_episodes(B.episodes(spark, sf_dir), root)
    return P.read_episodes(spark, root).select(F.col("show").alias("programme"), day("date"), "script", "audio_bytes", "has_sources_view")


@query
def episode_feed(spark, sf_dir):
    items = P.episode_items(B.episodes(spark, sf_dir), B.shows(spark, sf_dir))
    return items.select(
        F.col("show").alias("programme"), "guid", "title", "link", F.col("enclosure._length").alias("length"), F.col("enclosure._type").alias("type"),
        F.col("pubDate").alias("pub_date"), "description", "itunes_duration",
    )


@query
def episode_feed_scan(spark, sf_dir):
    path = new_path(spark, "episode-feed")
    P.write_episode_feed(P.episode_items(B.episodes(spark, sf_dir), B.shows(spark, sf_dir)), path)
    rows = P.read_episode_feed(spark, path)
    return rows.select(
        F.col("show").cast("string").alias("programme"), "title", "published", X.strip(F.col("description")).alias("description"),
        F.coalesce("sources_url", F.lit("")).alias("sources_url"), "audio_url",
    )


@query
def episode_feed_document(spark, sf_dir):
    """Whole feed documents, written and read back: the channel's header, once per show, and the number of its items."""
    path = new_path(spark, "feed-documents")
    facts = {"description": F.concat(F.lit("About "), "name", F.lit(" & more")), "language": F.lit("it"), "author": F.lit("Ada <Desk>"), "email": F.lit("desk@example.org"), "cover": F.lit("cover.png")}
    shows = B.shows(spark, sf_dir).withColumns(facts)
    P.write_feed_documents(P.episode_items(B.episodes(spark, sf_dir), B.shows(spark, sf_dir)), shows, path)
    items = P.read_episode_feed(spark, path).groupBy(F.col("show").cast("string").alias("show")).agg(F.count("*").alias("items"))
    found = P.read_feed_headers(spark, path).join(items, "show", "left")
    return found.select(F.col("show").alias("programme"), "title", "description", "language", "author", "cover", "link", F.coalesce("items", F.lit(0)).alias("items"))


@query
def episode_catalog(spark, sf_dir):
    items = P.episode_items(B.episodes(spark, sf_dir), B.shows(spark, sf_dir))
    rows = catalog.episode_catalog(items)
    return rows.select(F.col("show").cast("string").alias("programme"), "position", "title", "published", X.strip(F.col("blurb")).alias("blurb"))


def _analyzed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    clustered = B.labelled(spark, sf_dir)
    return clustered, materialize(S.analyze(clustered, ISSUE), "clusters")


@query
def stories_digest(spark, sf_dir):
    clustered, clusters = _analyzed(spark, sf_dir)
    return digests.stories_digest(clustered, clusters).select(*issue(), "rank", "block", "row", "line")


@query
def headline_context(spark, sf_dir):
    blocks = digests.headline_blocks(B.articles(spark, sf_dir))
    return positions(blocks, ISSUE, [F.col("source"), F.col("seq")], key=["source", "seq"]).select(*issue(), "position", "line")


@query
def short_context(spark, sf_dir):
    rows = digests.short_context(B.labelled(spark, sf_dir).drop("embedding"), B.episodes(spark, sf_dir))
    return rows.select(*issue(), "section", "source", "seq", "row", "line")


# Scalar functions


@query
def clean_html(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", X.clean_html(F.col("html")).alias("cleaned"))


@query
def clean_author(spark, sf_dir):
    who = F.col("source")
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("desk@example.org ("), who, F.lit(")")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Di  "), who))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("<b>"), who, F.lit("</b> &amp; "), F.col("lang")))
    )
    return B.table(spark, sf_dir, "documents").select("doc_id", X.clean_author(raw).alias("author"))


@query
def strip_feed_suffix(spark, sf_dir):
    rows = B.document_entries(spark, sf_dir).join(R.feed_dim(B.feeds(spark, sf_dir)), "feed_id")
    title = X.clean_html(F.col("title"))
    listed = X.is_aggregator(F.col("url"))
    return rows.select("seq", F.when(listed, X.strip_name_from_title(title, F.col("name"))).otherwise(title).alias("title"))


@query
def feed_patterns(spark, sf_dir):
    rows = B.document_entries(spark, sf_dir).join(R.feed_dim(B.feeds(spark, sf_dir)), "feed_id")
    title = X.strip_prefix_pattern(X.clean_html(F.col("title")), F.col("title_prefix"))
    text = X.strip_prefix_pattern(X.clean_html(F.col("summary")), F.col("description_prefix"))
    return rows.select(
        "seq",
        X.strip_suffix_pattern(title, F.col("title_suffix")).alias("title"),
        X.strip_suffix_pattern(text, F.col("description_suffix")).alias("description"),
    )


@query
def title_desc_dedupe(spark, sf_dir):
    title = F.col("title")
    text = F.when(F.col("seq") % 3 == 0, F.concat(F.replace(title, F.lit(" "), F.lit(" – ")), F.lit(" | "))).otherwise(F.col("description"))
    return B.articles(spark, sf_dir).select("seq", X.blank_useless(text, title, X.CleaningRules()).alias("description"))


@query
def clean_article(spark, sf_dir):
    rows = I.to_articles(I.validate(B.document_entries(spark, sf_dir)), R.feed_dim(B.feeds(spark, sf_dir)))
    return rows.select("seq", "source", "date", "title", "country", "description", "author", "link", stamp("published"))


def _date_shapes(spark, sf_dir) -> DataFrame:
    """Event times written in the shapes feeds use."""
    ts, later = F.col("ts").cast("timestamp"), F.col("ts").cast("timestamp") + F.expr("interval 1 hour")
    mail = "EEE, dd MMM yyyy HH:mm:ss"
    shapes = [
        F.concat(F.date_format(ts, mail), F.lit(" GMT")),
        F.concat(F.date_format(ts, mail), F.lit(" Z")),
        F.concat(F.date_format(later, mail), F.lit(" +0100")),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+01:00'"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        F.date_format(ts, "dd/MM/yyyy HH:mm"),
    ]
    text = F.element_at(F.array(*shapes), (F.col("event_id") % len(shapes) + 1).cast("int"))
    return B.table(spark, sf_dir, "events").select("event_id", "ts", text.alias("text"))


@query
def parse_published(spark, sf_dir):
    rows = _date_shapes(spark, sf_dir).withColumns(
        {"at": D.parse_published(F.col("text")), "strict": D.view_published(F.col("text"), strict_view=True)}
    )
    return rows.select("event_id", "text", stamp("at", "published"), stamp("strict", "view_published"))


@query
def time_display(spark, sf_dir):
    rows = _date_shapes(spark, sf_dir)
    return rows.select("event_id", D.time_display(D.wall_clock(F.col("text")), F.to_date("ts")).alias("shown"))


@query
def extract_domain(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", L.extract_domain(F.col("url")).alias("domain"))


@query
def embedding_text(spark, sf_dir):
    return E.with_embedding_text(B.articles(spark, sf_dir)).select("seq", "embedding_text")


@query
def italian_datetime(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select("event_id", D.italian_datetime(F.col("ts").cast("timestamp")).alias("shown"))


def _text_of(vector: Column) -> Column:
    return F.concat_ws(",", F.transform(vector, lambda x: F.format_number(x + 0.0, 5)))


@query
def l2_normalize(spark, sf_dir):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = B.table(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalize(tripled).alias("u"))
    return unit.select("vec_id", six(V.norm(F.col("u"))).alias("length"), six(F.col("u")[0]).alias("first"), six(F.aggregate("u", F.lit(0.0), lambda t, x: t + x)).alias("total"))


@query
def cosine_pairs(spark, sf_dir):
    rows = S.with_distances(B.labelled(spark, sf_dir), ISSUE)
    return rows.select("seq", "cluster_id", six("distance"))


@query
def desc_preview(spark, sf_dir):
    return B.articles(spark, sf_dir).select("seq", X.preview(F.col("description")).alias("preview"))


@query
def truncate_words(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.truncate_words(F.col("text")).alias("blurb"))


@query
def split_sources_link(spark, sf_dir):
    url = F.when(F.col("role") == "assistant", F.concat(F.lit("https://example.org/"), F.col("conv_id").cast("string")))
    rows = B.table(spark, sf_dir, "conversations").withColumn("described", X.with_sources_link(F.col("text"), url))
    return rows.select(
        "conv_id", "turn", F.coalesce(X.sources_link(F.col("described")), F.lit("")).alias("sources_url"),
        X.without_sources_link(F.col("described")).alias("description"),
    )


@query
def script_budget(spark, sf_dir):
    scripts = B.table(spark, sf_dir, "documents").withColumnRenamed("text", "script")
    return catalog.script_budget(scripts).select("doc_id", "spoken", F.col("script_length").cast("bigint").alias("script_length"), "is_cut")


@query
def infer_model(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 3 == 0, "-voyage").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("-"), "source")).otherwise("")
    path = F.concat(F.lit("/data/2024-01-05-sources-with-embeddings"), tail, F.lit(".parquet"))
    return B.table(spark, sf_dir, "documents").select("doc_id", L.model_name(path).alias("model"), L.issue_of_file(path).alias("issue"))


# Filters and ingest


@query
def validate_entries(spark, sf_dir):
    rows = I.validate(B.event_entries(spark, sf_dir))
    return rows.select("seq", F.coalesce("reason", F.lit("")).alias("reason"), stamp("published_at"))


@query
def age_filter(spark, sf_dir):
    rows = I.within_age(I.validate(B.event_entries(spark, sf_dir)).filter("reason is null"), B.as_of(), 7)
    return rows.select("seq", "feed_id", stamp("published_at"))


@query
def topn_per_feed(spark, sf_dir):
    rows = I.newest_per_feed(I.validate(B.event_entries(spark, sf_dir)).filter("reason is null"))
    return rows.select("feed_id", "seq", "rank")


@query
def validation_stats(spark, sf_dir):
    return I.validation_stats(I.validate(B.event_entries(spark, sf_dir)))


@query
def feed_stats(spark, sf_dir):
    return I.feed_stats(I.validate(B.event_entries(spark, sf_dir)), B.as_of(), 2)


@query
def dedupe_articles(spark, sf_dir):
    return I.dedupe(B.articles(spark, sf_dir)).select("seq", "source", "title")


@query
def dedupe_removed(spark, sf_dir):
    rows = B.articles(spark, sf_dir)
    return I.removed_count(rows, I.dedupe(rows))


@query
def ingest_articles(spark, sf_dir):
    rows = I.ingest(B.event_entries(spark, sf_dir), R.feed_dim(_event_feeds(spark, sf_dir)), B.as_of(), 7)
    return rows.select("seq", "source", "date", "title", "description", stamp("published"))


def _event_feeds(spark, sf_dir) -> DataFrame:
    types = B.table(spark, sf_dir, "events").select("event_type").distinct()
    return types.select(F.col("event_type").alias("feed_id"), F.col("event_type").alias("name"))


@query
def union_feeds(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("seq"), F.col("url").alias("link"))
    events = B.event_entries(spark, sf_dir).select(F.col("feed_id").alias("source"), "seq", "title")
    rows = I.union_feeds(B.articles(spark, sf_dir).select("source", "seq", "title", "link"), events, pages)
    return rows.select("source", "seq", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("link", F.lit("")).alias("link"))


@query
def group_by_source(spark, sf_dir):
    rows = views.source_listing(B.articles(spark, sf_dir).select(*ISSUE, "source", "seq"))
    return rows.select(day(), "source", "source_articles", "position", "seq")


@query
def stream_ingest(spark, sf_dir):
    spark = B.prepare(spark)
    landed, out, marks = (new_path(spark, name) for name in ("landed", "streamed", "marks"))
    entries = B.document_entries(spark, sf_dir)
    # Several batches: the result doesn't depend on how entries arrive.
    files = land_entries(entries, landed)
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", files).parquet(landed)
    start_ingest(stream_articles(stream, R.feed_dim(B.feeds(spark, sf_dir))), out, marks).awaitTermination()
    return spark.read.parquet(out).select("source", "title")


@query
def stream_newest(spark, sf_dir):
    """The batch ingest, newest per feed included, as a stream whose files arrive last entry first."""
    spark = B.prepare(spark)
    landed, out, marks = (new_path(spark, name) for name in ("landed", "streamed", "marks"))
    entries = B.event_entries(spark, sf_dir)
    files = land_entries(entries, landed, F.desc("seq"))
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", files).parquet(landed)
    collect_entries(stream, out, marks, B.as_of(), 7).awaitTermination()
    rows = collected_articles(collected_entries(spark, out), R.feed_dim(_event_feeds(spark, sf_dir)))
    return rows.select("seq", "source", "date", "title", "description", stamp("published"))


# Joins


@query
def other_headlines(spark, sf_dir):
    rows = B.labelled(spark, sf_dir).drop("embedding")
    clusters = S.categorize(S.cluster_metrics(rows, ISSUE))
    return S.other_headlines(rows.drop("cluster_id"), rows, clusters, ISSUE).select(*issue(), "seq", "source", "title")


@query
def attach_embeddings(spark, sf_dir):
    found = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), "embedding")
    rows = A.attach_embeddings(B.articles(spark, sf_dir), found, ["seq"]).filter("embedding is not null")
    return rows.select("seq", "title", F.size("embedding").cast("bigint").alias("dimensions"), six(F.col("embedding")[0].cast("double")).alias("first"))


@query
def attach_all_embeddings(spark, sf_dir):
    """Every article with the whole vector as text, empty for those without one."""
    found = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), "embedding")
    rows = A.attach_embeddings(B.articles(spark, sf_dir), found, ["seq"])
    whole = F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000, 0).cast("bigint").cast("string")), ",")
    return rows.select("seq", F.coalesce(whole, F.lit("")).alias("vector"))


@query
def missing_embeddings(spark, sf_dir):
    found = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), "embedding")
    rows = A.attach_embeddings(B.articles(spark, sf_dir), found, ["seq"])
    return A.without_embedding(rows, ["source"]).select("source", "articles", "without_vector")


@query
def similarity_join(spark, sf_dir):
    return _all_pairs(B.vectors(spark, sf_dir)).select("id", "partner", six("distance"))


def _all_pairs(rows: DataFrame) -> DataFrame:
    """Every pair of articles, those of copies too."""
    members = C.copy_groups(rows, ISSUE)
    return C.expand_pairs(C.similarity_join(rows, ISSUE, 0.75, members=members), members, ISSUE)


@query
def similarity_join_copies(spark, sf_dir):
    """The join over vectors of which every seventh is there twice, with all pairs of copies."""
    rows = B.vectors(spark, sf_dir)
    twice = rows.filter(F.col("seq") % 7 == 0).withColumn("seq", F.col("seq") + 1_000_000_000)
    rows = materialize(rows.unionByName(twice), "doubled")
    return _all_pairs(rows).select("id", "partner", six("distance"))


@query
def previous_episode(spark, sf_dir):
    rows = B.episodes(spark, sf_dir)
    issues = rows.select("show", F.col("date").alias("issue_date"))
    return digests.previous_episode(issues, rows).select(*issue(), day("previous_date"), "previous_script")


@query
def contingency(spark, sf_dir):
    return G.contingency(*B.given_labels(spark, sf_dir), ["seq"])


@query
def top_stories_compare(spark, sf_dir):
    clustered = B.labelled(spark, sf_dir).withColumns(
        {
            "show": F.lit("all"),
            "issue_date": F.to_date(F.lit("2024-01-02")),
            "source": F.concat(F.lit("src"), (F.col("seq") % 23).cast("string")),
        }
    )
    a = S.top_stories(S.analyze(clustered, ISSUE), ISSUE)
    b = S.top_stories(S.analyze(clustered.withColumn("cluster_id", F.col("seq") % 12), ISSUE), ISSUE)
    rows = G.top_stories_compare(a, b)
    return rows.select(
        "rank",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size_a", "sources_a", "size_b", "sources_b")],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("label_a", "label_b")],
        *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("diversity_a", "diversity_b")],
    )


# Aggregates, ranking and views


@query
def cluster_metrics(spark, sf_dir):
    rows = S.cluster_metrics(B.labelled(spark, sf_dir), ISSUE)
    return rows.select(*issue(), "cluster_id", "size", "n_sources", F.concat_ws(",", "sources").alias("sources"), six("diversity_score"), six("importance_score"))


@query
def cluster_medoid(spark, sf_dir):
    rows = S.medoids(B.labelled(spark, sf_dir), ISSUE)
    return rows.select(*issue(), "cluster_id", "medoid_seq", "label", "description")


@query
def story_categories(spark, sf_dir):
    rows = S.categorize(S.cluster_metrics(B.labelled(spark, sf_dir), ISSUE))
    return rows.select(*issue(), "cluster_id", "size", "category", "junk_reason")


@query
def analysis_summary(spark, sf_dir):
    rows = S.analysis_summary(S.cluster_metrics(B.labelled(spark, sf_dir), ISSUE), ISSUE)
    return rows.select(*issue(), "total_articles", "total_clusters", "singletons")


@query
def view_stats(spark, sf_dir):
    rows = views.view_stats(B.labelled(spark, sf_dir))
    return rows.select(*issue(), "total_articles", "source_count", "cluster_count", "clustered_count", "unclustered_count", "clustered_pct")


@query
def top_stories(spark, sf_dir):
    rows = S.top_stories(S.categorize(S.cluster_metrics(B.labelled(spark, sf_dir), ISSUE)), ISSUE)
    return rows.select(*issue(), F.col("rank").cast("bigint").alias("rank"), "cluster_id", "size", six("importance_score"))


@query
def story_cards(spark, sf_dir):
    rows = views.story_cards(B.labelled(spark, sf_dir))
    return rows.select(
        *issue(), "rank", "cluster_id", "size", "n_sources", six("diversity_score"), six("importance_score"), "label",
        F.concat_ws(",", "icons").alias("icons"), "more",
    )


@query
def story_domains(spark, sf_dir):
    rows = views.story_domains(views.with_view_columns(B.labelled(spark, sf_dir).drop("embedding")), limit=2)
    return rows.select(*issue(), "cluster_id", F.concat_ws(",", "icons").alias("icons"), "more")


@query
def unclustered(spark, sf_dir):
    return C.unclustered(B.labelled(spark, sf_dir).drop("embedding"), ISSUE).select(*issue(), "seq", "source", "title")


@query
def unclustered_by_source(spark, sf_dir):
    rows = views.unclustered_by_source(B.labelled(spark, sf_dir))
    return rows.select(*issue(), "source", "source_rank", "source_articles", "position", "seq", "time_display")


@query
def sources_view(spark, sf_dir):
    rows = views.card_articles(B.labelled(spark, sf_dir))
    return rows.select(*issue(), "cluster_id", "position", "seq", "source", "domain", "time_display", "preview")


@query
def briefing_context(spark, sf_dir):
    clustered, clusters = _analyzed(spark, sf_dir)
    others = S.other_headlines(clustered.drop("embedding", "cluster_id", "distance"), clustered, clusters, ISSUE)
    rows = digests.briefing_context(clustered, clustered, clusters, others, B.episodes(spark, sf_dir))
    return rows.select(*issue(), "section", "rank", "block", "row", "line")


# Clustering on the vectors themselves


@query
def hac_average(spark, sf_dir):
    return C.assign(B.vectors(spark, sf_dir), ISSUE, NEAR).select("id", "cluster_id")


@query
def hac_average_rounds(spark, sf_dir):
    """The same clustering with every merge found by the distributed rounds."""
    return C.assign(B.vectors(spark, sf_dir), ISSUE, NEAR, local_limit=64, tile_rows=2048).select("id", "cluster_id")


@query
def hac_single(spark, sf_dir):
    return C.assign(B.vectors(spark, sf_dir), ISSUE, 0.70, "single").select("id", "cluster_id")


@query
def hac_single_rounds(spark, sf_dir):
    return C.assign(B.vectors(spark, sf_dir), ISSUE, 0.70, "single", local_limit=64, tile_rows=2048).select("id", "cluster_id")


@query
def hac_complete(spark, sf_dir):
    return C.assign(B.vectors(spark, sf_dir), ISSUE, NEAR, "complete").select("id", "cluster_id")


@query
def hac_complete_rounds(spark, sf_dir):
    return C.assign(B.vectors(spark, sf_dir), ISSUE, NEAR, "complete", local_limit=64, tile_rows=2048).select("id", "cluster_id")


@query
def daily_analysis(spark, sf_dir):
    _, clusters = analyze_day(B.vectors(spark, sf_dir), NEAR)
    return S.top_stories(clusters, ISSUE).select(
        *issue(), "rank", "cluster_id", "label", "size", "n_sources", six("diversity_score"), six("importance_score"), "category"
    )


@query
def hac_single_history(spark, sf_dir):
    """Single linkage at three thresholds, from one history that a spanning forest gives."""
    tree = C.merge_tree(B.vectors(spark, sf_dir), ISSUE, 0.75, "single", local_limit=64, tile_rows=256)
    return C.cut_many(tree, ISSUE, [0.65, 0.70, 0.75]).select("threshold", "id", "cluster_id")


@query
def daily_analysis_rounds(spark, sf_dir):
    """The daily analysis with every merge found by the distributed rounds."""
    _, clusters = analyze_day(B.vectors(spark, sf_dir), NEAR, local_limit=64, tile_rows=2048)
    return S.top_stories(clusters, ISSUE).select(
        *issue(), "rank", "cluster_id", "label", "size", "n_sources", six("diversity_score"), six("importance_score"), "category"
    )


@query
def daily_briefing(spark, sf_dir):
    """The whole daily run on documents: vectors, clusters, digest, other headlines, prompt lines."""
    embedded = E.embed_hashing(I.dedupe(B.articles(spark, sf_dir), ISSUE))
    # No later step reads the embedded text, so it is not moved with the articles.
    clustered, clusters = analyze_day(embedded.drop("embedding_text"), X.CLUSTER_THRESHOLD)
    others = S.other_headlines(clustered.drop("embedding", "cluster_id", "distance"), clustered, clusters, ISSUE)
    rows = digests.briefing_context(clustered, clustered, clusters, others, B.episodes(spark, sf_dir))
    return rows.select(*issue(), "section", "rank", "block", "row", "line")


@query
def embed_articles(spark, sf_dir):
    rows = E.embed(B.articles(spark, sf_dir), "letters")
    return rows.select("seq", _letters().alias("vector"), "provider")


@query
def embed_hashing(spark, sf_dir):
    rows = E.embed_hashing(B.articles(spark, sf_dir))
    return rows.select("seq", _text_of(F.col("embedding")).alias("vector"))


# Evaluation


@query
def distance_percentiles(spark, sf_dir):
    rows = evaluation.distance_percentiles(B.vectors(spark, sf_dir))
    return rows.select(*[six(c) for c in rows.columns])


@query
def threshold_sweep(spark, sf_dir):
    return evaluation.threshold_sweep(B.vectors(spark, sf_dir), ISSUE, GRID).drop(*ISSUE)


@query
def suggest_threshold(spark, sf_dir):
    sweep = evaluation.threshold_sweep(B.vectors(spark, sf_dir), ISSUE, GRID)
    return evaluation.suggest_threshold(sweep, ISSUE).select("threshold", "reason")


@query
def threshold_sweep_rounds(spark, sf_dir):
    return evaluation.threshold_sweep(B.vectors(spark, sf_dir), ISSUE, GRID, local_limit=64, tile_rows=2048).drop(*ISSUE)


@query
def suggest_threshold_rounds(spark, sf_dir):
    sweep = evaluation.threshold_sweep(B.vectors(spark, sf_dir), ISSUE, GRID, local_limit=64, tile_rows=2048)
    return evaluation.suggest_threshold(sweep, ISSUE).select("threshold", "reason")


@query
def model_comparison(spark, sf_dir):
    """All of each vector against its first half: chosen thresholds and how far the two clusterings agree."""
    whole = B.vectors(spark, sf_dir)
    half = whole.withColumn("embedding", F.slice("embedding", 1, 32))
    a, b = (models.evaluate_model(v, ISSUE, [0.50, 0.60, 0.70, 0.80]) for v in (whole, half))
    chosen = a.choice.select(F.col("threshold").alias("threshold_a")).crossJoin(b.choice.select(F.col("threshold").alias("threshold_b")))
    return models.compare_models(a, b, ISSUE).indexes.crossJoin(chosen).select("articles", six("adjusted_rand"), six("nmi"), "threshold_a", "threshold_b")


def _unit_labels(spark, sf_dir) -> DataFrame:
    return evaluation.unit_labels(B.labelled(spark, sf_dir), ISSUE, "cluster_id")


@query
def silhouette(spark, sf_dir):
    rows = evaluation.silhouette(_unit_labels(spark, sf_dir), ISSUE)
    return rows.select(*issue(), six("silhouette"))


@query
def intra_similarity(spark, sf_dir):
    rows = evaluation.intra_similarity(_unit_labels(spark, sf_dir), ISSUE)
    return rows.select(*issue(), six("mean_intra_sim"))


def _titles(spark, sf_dir) -> DataFrame:
    return B.labelled(spark, sf_dir).select("seq", "title")


def _report(a: DataFrame, b: DataFrame, titles: DataFrame) -> DataFrame:
    rows = G.cluster_splits(a, b, ["seq"], titles.select("seq", "title"))
    return rows.select(
        F.col("rank").cast("bigint").alias("rank"), "label", "size", "pieces", F.col("sample").cast("bigint").alias("sample"), "other_label", "title"
    )


@query
def cluster_splits(spark, sf_dir):
    a, b = B.given_labels(spark, sf_dir)
    return _report(a, b, _titles(spark, sf_dir))


@query
def cluster_merges(spark, sf_dir):
    a, b = B.given_labels(spark, sf_dir)
    return _report(b, a, _titles(spark, sf_dir))


@query
def adjusted_rand(spark, sf_dir):
    return G.adjusted_rand(G.contingency(*B.given_labels(spark, sf_dir), ["seq"])).select(six("adjusted_rand"))


@query
def nmi(spark, sf_dir):
    return G.nmi(G.contingency(*B.given_labels(spark, sf_dir), ["seq"])).select(six("nmi"))
