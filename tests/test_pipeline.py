from __future__ import annotations

from datetime import date, datetime

import numpy as np
import pytest
from brute import greedy, intra, silhouette
from pyspark.sql import functions as F

from bindings import tables as B
from bindings.landing import land_entries
from storyline.functions.text import CleaningRules
from storyline.operators import agreement as G
from storyline.operators import embed as E
from storyline.operators import ingest as I
from storyline.operators import stories as S
from storyline.operators.nearest import near_pairs, nearest_within
from storyline.operators.ordering import first_rows, positions
from storyline.plans import digests, evaluation, models, views
from storyline.plans.analysis import daily_analysis
from storyline.schema import ISSUE
from storyline.session import new_path
from storyline.sources import articles as A
from storyline.sources import feeds as R
from storyline.streaming.ingest import collect_entries, collected_articles, collected_entries, start_ingest, stream_articles

DATA = "/root/testdata/sf0.001"
ENTRY = "feed_id string, title string, published string, description string, summary string, author string, link string, seq bigint"
DAY = "Sat, 07 Feb 2026 "


def entries(spark, rows):
    full = [(f, t, p, d, None, a, None, i) for i, (f, t, p, d, a) in enumerate(rows)]
    return spark.createDataFrame(full, ENTRY)


def feeds(spark):
    return R.feeds_from_config(
        spark,
        {
            "feeds": [
                {"name": "Il Post", "url": "https://news.google.com/rss?x", "country": "Italy"},
                {"name": "AGI", "url": "https://e.org/agi", "country": "Italy", "cleaning": {"description_prefix": r"^AGI\s*-\s*"}},
            ]
        },
    )


def test_ingest_by_hand(spark):
    rows = [
        ("Il Post", "One &amp; two - Il Post", DAY + "10:00:00 GMT", "A long enough text here Il Post", "a@b.it (Ada)"),
        ("Il Post", "One &amp; two", DAY + "11:00:00 GMT", "Second of the same", None),
        ("AGI", "Three - Il Post", DAY + "12:00:00 +0100", "AGI - a text that stays in place", "di Ugo"),
        ("AGI", "", DAY + "12:00:00 GMT", "x", None),
        ("AGI", "No date", None, "x", None),
        ("AGI", "Bad date", "soon", "x", None),
        ("AGI", "Old", "Thu, 05 Feb 2026 11:59:59 GMT", "x", None),
        ("AGI", "At the edge", "Fri, 06 Feb 2026 12:00:00 GMT", "x", None),
    ]
    raw = entries(spark, rows)
    now = F.to_timestamp(F.lit("2026-02-07 12:00:00"))
    found = {r.seq: r for r in I.ingest(raw, feeds(spark), now, 1).collect()}
    assert sorted(found) == [0, 2, 7]
    assert (found[0].title, found[0].description, found[0].author) == ("One & two", "A long enough text here", "Ada")
    assert (found[2].title, found[2].description, found[2].author) == ("Three - Il Post", "a text that stays in place", "Ugo")
    assert found[7].description == ""
    checked = I.validate(raw)
    reasons = {r.reason: r.entries for r in I.validation_stats(checked).collect()}
    assert reasons == {"Missing title": 1, "Missing published date": 1, "Invalid date format": 1}
    stats = {r.feed_id: (r.total, r.failed, r.recent, r.kept) for r in I.feed_stats(checked, now, 1, 1).collect()}
    assert stats == {"Il Post": (2, 0, 2, 1), "AGI": (6, 3, 2, 1)}


def test_rules_can_be_switched_off(spark):
    raw = entries(spark, [("Il Post", "T - Il Post", DAY + "10:00:00 GMT", "short", None)])
    rules = CleaningRules(google_news_auto_clean=False, min_description_length=0, dedupe_title_description=False)
    row = I.to_articles(I.validate(raw), feeds(spark), rules).first()
    assert (row.title, row.description) == ("T - Il Post", "short")
    assert R.cleaning_from_config({"cleaning": {"cluster_threshold": 0.34, "empty_values": ["x"]}}) == CleaningRules(
        empty_values=("x",), cluster_threshold=0.34
    )


def test_first_rows_and_positions_in_a_hot_group(spark):
    df = spark.range(4000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 30).cast("string"))).alias("g"),
        (F.col("id") * 7919 % 101).alias("v"),
    )
    order = [F.col("v").desc(), F.col("seq")]
    want = df.toPandas().sort_values(["v", "seq"], ascending=[False, True])
    want["position"] = want.groupby("g").cumcount() + 1
    expected = dict(zip(want.seq, want.position))
    placed = positions(df.repartition(9), ["g"], order).collect()
    assert {r.seq: r.position for r in placed} == expected
    top = first_rows(df, ["g"], order, 10).collect()
    assert {r.seq: r["rank"] for r in top} == {s: p for s, p in expected.items() if p <= 10}
    nulls = df.withColumn("g", F.when(F.col("g") != "hot", F.col("g")))
    assert positions(nulls, ["g"], order).count() == 4000


def test_class_edges(spark):
    cases = {1: (2, 1, "niche"), 2: (3, 1, "junk"), 3: (3, 2, "top"), 4: (10, 2, "niche"), 5: (10, 3, "top"), 6: (1, 1, "niche")}
    rows = [("s", c, f"src{i % n}") for c, (size, n, _) in cases.items() for i in range(size)]
    found = S.categorize(S.cluster_metrics(spark.createDataFrame(rows, "show string, cluster_id bigint, source string"), ["show"]))
    for row in found.collect():
        size, n, category = cases[row.cluster_id]
        assert (row.size, row.n_sources, row.category) == (size, n, category)
        assert row.importance_score == (size + n) / 2
        assert row.junk_reason == ("Single source (src0)" if category == "junk" else "")


def test_nearest_partner_matches_all_pairs(spark):
    rng = np.random.default_rng(1)
    u = rng.normal(size=(70, 5))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    df = spark.createDataFrame([("s", i, [float(x) for x in v]) for i, v in enumerate(u)], "show string, id bigint, vec array<double>")
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    for tile_rows in (1000, 15):
        found = nearest_within(df, ["show"], None, tile_rows).collect()
        assert {r.id: r.partner for r in found} == dict(enumerate(d.argmin(axis=1)))
        pairs = near_pairs(df, ["show"], 0.3, tile_rows).collect()
        assert sorted((r.id, r.partner) for r in pairs) == sorted(zip(*np.nonzero(np.triu(d < 0.3, 1))))


@pytest.fixture(scope="module")
def sample(spark):
    rows = B.vectors(spark, DATA).filter("seq < 120")
    vectors = np.array([r.embedding for r in rows.orderBy("seq").collect()], dtype=float)
    return rows, vectors


def test_sweep_matches_pairwise_metrics(spark, sample):
    rows, vectors = sample
    grid = [0.6, 0.7, 0.8]
    sweep = evaluation.threshold_sweep(rows, ISSUE, grid).orderBy("threshold").collect()
    for row, t in zip(sweep, grid):
        labels = greedy(vectors, t)
        sizes = np.unique(labels, return_counts=True)[1]
        assert (row.n_clusters, row.n_singletons) == (len(sizes), (sizes == 1).sum())
        assert row.pct_clustered == pytest.approx(100 * (1 - (sizes == 1).sum() / 120), abs=0.051)
        expected = silhouette(vectors, labels)
        assert (row.silhouette is None) if expected is None else row.silhouette == pytest.approx(expected, abs=6e-5)
        assert row.mean_intra_sim == pytest.approx(intra(vectors, labels), abs=6e-5)


def test_suggested_threshold(spark):
    schema = "show string, threshold double, silhouette double, pct_clustered double, task_score double"
    rows = [("a", 0.1, 0.9, 10.0, 9.0), ("a", 0.2, 0.4, 30.0, 2.0), ("a", 0.3, 0.31, 40.0, 5.0), ("a", 0.4, 0.29, 50.0, 9.0), ("a", 0.5, 0.35, 60.0, 5.0),
            ("b", 0.1, None, 50.0, 1.0), ("b", 0.2, None, 60.0, 3.0), ("b", 0.3, 0.5, 10.0, 3.0),
            ("c", 0.1, -0.1, 50.0, 1.0), ("c", 0.2, -0.2, 60.0, 3.0)]
    found = {r.show: r for r in evaluation.suggest_threshold(spark.createDataFrame(rows, schema), ["show"]).collect()}
    assert found["a"].threshold == 0.3
    assert found["a"].reason == "silhouette peak=0.4000 (pct_clustered>=20%), quality band=[0.20, 0.50], chosen silhouette=0.3100, task_score=5.00"
    assert found["b"].threshold == 0.2 and found["b"].reason.startswith("fallback") and found["b"].reason.endswith("max task_score=3.0")
    assert found["c"].threshold == 0.2 and "[0.10, 0.20]" in found["c"].reason
    assert evaluation.threshold_grid()[0] == 0.1 and len(evaluation.threshold_grid()) == 31 and evaluation.threshold_grid()[-1] == 0.7


def test_daily_analysis_invariants(spark):
    rows = B.vectors(spark, DATA)
    clustered, clusters = daily_analysis(rows, 0.8)
    summary = S.analysis_summary(clusters, ISSUE).first()
    assert summary.total_articles == rows.count() == clustered.select("seq").distinct().count()
    assert summary.total_clusters == clusters.count()
    told = S.top_stories(clusters, ISSUE).orderBy("rank").collect()
    scores = [r.importance_score for r in told]
    assert scores == sorted(scores, reverse=True) and len(told) <= 20
    assert all(r.size >= 3 and r.n_sources > 1 and r.diversity_score >= 0.3 for r in told)
    others = S.other_headlines(rows.drop("embedding"), clustered, clusters, ISSUE)
    top = clusters.filter("category = 'top'").agg(F.sum("size")).first()[0]
    assert others.count() == rows.count() - top
    more = S.other_headlines(rows.drop("embedding"), clustered, clusters, ISSUE, printed_only=True)
    assert more.count() >= others.count()
    none = S.analysis_summary(clusters.limit(0), []).first()
    assert (none.total_articles, none.total_clusters, none.singletons) == (0, 0, 0)


def test_agreement_extremes(spark):
    same = spark.createDataFrame([(i, i % 3) for i in range(12)], "seq bigint, label bigint")
    cells = G.contingency(same, same.withColumn("label", F.col("label") + 5), ["seq"])
    assert G.adjusted_rand(cells).first()[0] == pytest.approx(1) and G.nmi(cells).first()[0] == pytest.approx(1)
    one = same.withColumn("label", F.lit(1).cast("bigint"))
    assert G.nmi(G.contingency(one, one, ["seq"])).first()[0] == 1.0
    assert G.cluster_splits(same, same, ["seq"]).count() == 0


def test_issue_store(spark):
    path = new_path(spark, "articles")
    rows = B.articles(spark, DATA)
    A.write_articles(rows, path)
    stored = A.read_articles(spark, path)
    assert stored.count() == rows.count()
    A.write_articles(rows.limit(0), path)
    assert A.read_articles(spark, path).count() == rows.count()
    assert A.new_issues(rows, stored).count() == 0
    assert A.new_issues(rows, stored, force_refresh=True).count() == rows.count()
    one = rows.filter("issue_date = date '2024-01-01'")
    A.write_articles(one.limit(3), path)  # replaces that issue only
    assert A.read_articles(spark, path).count() == rows.count() - one.count() + 3
    assert A.refresh(rows, one.select(*rows.columns)).count() == rows.count()


def test_providers(spark):
    rows = B.articles(spark, DATA).limit(130).select("seq", "title", "description")
    calls = []

    def factory():
        return lambda texts: [[float(len(texts))] for _ in texts]

    E.register_provider("sizes", factory)
    sizes = [int(r.embedding[0]) for r in E.embed(rows.coalesce(1), "Sizes").collect()]
    assert sorted(set(sizes)) == [30, 50] and len(sizes) == 130 and not calls
    with pytest.raises(ValueError, match="unknown embedding provider"):
        E.embed(rows, "nobody")
    E.register_provider("short", lambda: lambda texts: [])
    with pytest.raises(Exception, match="another number of vectors"):
        E.embed(rows, "short").collect()
    unit = E.embed_hashing(rows).select(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x * x).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-5 or r.n == 0 for r in unit)


def test_a_text_is_sent_once(spark):
    sent = spark.sparkContext.accumulator(0)

    def factory():
        def call(texts):
            sent.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return call

    E.register_provider("counted", factory)
    rows = B.articles(spark, DATA).limit(60)
    embedded = E.embed(rows, "counted")
    daily_analysis(embedded, 0.01)
    evaluation.threshold_sweep(embedded, ["show", "issue_date"], [0.01, 0.02]).collect()
    assert sent.value == 60


def test_stream_does_not_depend_on_batches(spark):
    raw = B.document_entries(spark, DATA)
    future = raw.limit(1).withColumns({"title": F.lit("From the future"), "published": F.lit("Sat, 07 Feb 2099 18:45:06 GMT"), "seq": F.lit(10**6)})
    raw = raw.unionByName(future)
    dim = R.feed_dim(B.feeds(spark, DATA))
    as_of = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    good = I.within_age(I.validate(raw).filter("reason is null"), as_of)
    key = lambda df: sorted((r.source, r.title) for r in df.collect())
    expected = key(I.dedupe(I.to_articles(good, dim)))
    assert any("future" in t for _, t in expected)
    for order, files in (("seq", 1), ("seq", 3), ("-seq", 3)):
        landed, out, marks = (new_path(spark, n) for n in ("landed", "streamed", "marks"))
        parts = raw.repartitionByRange(files, F.expr(order)).withColumn("part", F.spark_partition_id())
        for part in range(files):  # one file after the other, so that they arrive in this order
            parts.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(landed)
        start_ingest(stream_articles(stream, dim, as_of), out, marks).awaitTermination()
        assert key(spark.read.parquet(out)) == expected


def test_collected_stream_equals_the_batch(spark):
    """Whole rows, newest per feed included, for one file and many, in either order, with an entry from the future."""
    raw = B.document_entries(spark, DATA)
    future = raw.limit(1).withColumns({"title": F.lit("From the future"), "published": F.lit("Sat, 07 Feb 2099 18:45:06 GMT"), "seq": F.lit(10**6)})
    raw = raw.unionByName(future).unionByName(raw.filter("seq % 5 = 0").withColumns({"seq": F.col("seq") + 5000, "link": F.lit("again")}))
    dim, as_of = R.feed_dim(B.feeds(spark, DATA)), F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    expected = rows(I.ingest(raw, dim, as_of, limit=4))
    assert any("future" in str(r) for r in expected)
    for order, files in (("seq", 1), ("seq", 3), ("-seq", 3)):
        landed, out, marks = (new_path(spark, n) for n in ("landed", "streamed", "marks"))
        parts = raw.repartitionByRange(files, F.expr(order)).withColumn("part", F.spark_partition_id())
        for part in range(files):
            parts.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(landed)
        collect_entries(stream, out, marks, as_of, limit=4).awaitTermination()
        assert rows(collected_articles(collected_entries(spark, out, 4), dim)) == expected
        first = collected_entries(spark, out, 4, until=0)
        again = collected_entries(spark, out, 4, earlier=first, after=0)  # merged lists merge again
        assert rows(collected_articles(again, dim)) == expected


def test_landed_entries_are_many_files(spark):
    """No file holds a fixed share of all entries, and all rows arrive, in several batches."""
    entries = B.document_entries(spark, DATA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        for order in ((), (F.desc("seq"),)):
            path = new_path(spark, "landed")
            assert land_entries(entries, path, *order) == 3
            landed = spark.read.parquet(path)
            assert 4 < len(landed.inputFiles()) <= 10
            assert sorted(map(tuple, landed.select(*entries.columns).collect()), key=repr) == sorted(map(tuple, entries.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_broken_feed_items_are_skipped(spark, tmp_path):
    for feed, body in {"a": "<item><title>x</title><pubDate>d</pubDate><dc:creator>Ada</dc:creator></item>", "b": "<item><title>y</item><item>", "c": "no xml"}.items():
        folder = tmp_path / f"feed_id={feed}"
        folder.mkdir()
        (folder / "f.xml").write_text(f'<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>{body}</channel></rss>')
    found = R.read_rss(spark, str(tmp_path)).filter("published is not null").collect()
    assert [(r.feed_id, r.title, r.author) for r in found] == [("a", "x", "Ada")]
    assert {r.reason for r in R.read_rejects(spark, str(tmp_path)).collect()} <= {"Broken item"}


def test_atom_and_the_audit(spark, tmp_path):
    bodies = {
        "a": """<feed><entry><title type="html">One &amp; two</title><published>2026-02-07T10:00:00Z</published><content>Body</content>
            <author><name>Ada</name><email>a@b.it</email></author><link rel="self" href="s"/><link href="http://x"/></entry>
            <entry><title>Two</title><summary>Sum</summary><author><name>Bo</name></author></entry></feed>""",
        "b": "<rss><channel><item><title>kept</title></item><item><title>lost</titel></item></channel></rss>",
        "c": "no feed",
        "d": "<rss><channel><item><link>l</link></item></channel></rss>",
    }
    for feed, body in bodies.items():
        (tmp_path / f"feed_id={feed}").mkdir()
        (tmp_path / f"feed_id={feed}" / "f.xml").write_text(body)
    found = sorted(tuple(r) for r in R.read_rss(spark, str(tmp_path)).select("feed_id", "title", "published", "summary", "author", "link").collect() if r.title)
    assert found == [
        ("a", "One & two", "2026-02-07T10:00:00Z", "Body", "Ada (a@b.it)", "http://x"),
        ("a", "Two", None, "Sum", "Bo", None),
        ("b", "kept", None, None, None, None),
    ]
    assert {(r.feed_id, r.reason) for r in R.read_rejects(spark, str(tmp_path)).collect()} == {("b", "Broken item"), ("c", "Broken item")}
    assert R.read_rejects(spark, str(tmp_path)).count() == 2
    audit = {r.feed_id: tuple(r)[1:] for r in R.audit_feeds(spark, str(tmp_path)).collect()}
    assert audit == {"a": (1, 0, 0, 2, 0), "b": (1, 1, 0, 1, 0), "c": (1, 1, 1, 0, 0), "d": (1, 0, 0, 1, 1)}


def test_two_models(spark, sample):
    rows, vectors = sample
    half = rows.withColumn("embedding", F.slice("embedding", 1, 32))
    grid = [0.5, 0.6, 0.7]
    a, b = (models.evaluate_model(v, ISSUE, grid) for v in (rows, half))
    told = []
    for model, plain in ((a, vectors), (b, vectors[:, :32])):
        t = model.choice.first().threshold
        assert t == evaluation.suggest_threshold(evaluation.threshold_sweep(rows if model is a else half, ISSUE, grid), ISSUE).first().threshold
        labels = greedy(plain, t)
        assert [r.cluster_id for r in model.labels.orderBy("id").collect()] == labels.tolist()
        told.append(labels)
    found = models.compare_models(a, b, ISSUE)
    cells = np.zeros((120, 120))
    np.add.at(cells, tuple(told), 1)
    pairs = lambda x: (x * (x - 1) / 2).sum()
    both, rows_, columns = pairs(cells), pairs(cells.sum(1)), pairs(cells.sum(0))
    expected = rows_ * columns / pairs(np.array([120]))
    index = found.indexes.first()
    assert index.articles == 120 and index.adjusted_rand == pytest.approx((both - expected) / ((rows_ + columns) / 2 - expected))
    broken = ((cells > 0).sum(1) > 1) & (cells.sum(1) > 1)
    assert found.splits.count() == min(5, broken.sum())
    assert found.stories.count() == min(10, max(m.clusters.filter("category = 'top'").count() for m in (a, b)))


def test_kept_word_counts_weigh_batches_alike(spark):
    rows = spark.createDataFrame([(i, f"Word{i % 7} über die Stadt", f"text number {i % 3} Straße") for i in range(60)] + [(60, None, None), (61, "", "")], "seq bigint, title string, description string")
    parts = [rows.filter("seq < 20"), rows.filter("seq >= 20")]
    counts = E.merge_counts(*map(E.document_counts, parts))
    kept = {r.bucket: r.texts for r in counts.collect()}
    assert kept == {r.bucket: r.texts for r in E.document_counts(rows).collect()} and kept[-1] == 62
    vectors = lambda df: {r.seq: r.embedding for r in df.collect()}
    whole = vectors(E.embed_hashing(rows))
    assert {k: v for p in parts for k, v in vectors(E.embed_hashing(p, counts=counts)).items()} == whole
    E.register_provider("kept", E.hashing_provider(E.bucket_weights(counts)))
    named = vectors(E.embed(rows, "kept"))
    assert all(np.allclose(named[k], whole[k], atol=1e-6) for k in whole)
    assert len(E.embed(rows, "hashing").first().embedding) == E.HASH_DIMENSIONS


def test_articles_without_a_vector_stay(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "seq bigint, source string")
    vectors = spark.createDataFrame([(1, [1.0])], "seq bigint, embedding array<double>")
    found = A.attach_embeddings(rows, vectors, ["seq"])
    assert sorted((r.seq, r.embedding) for r in found.collect()) == [(1, [1.0]), (2, None), (3, None)]
    assert sorted(map(tuple, A.without_embedding(found, ["source"]).collect())) == [("x", 2, 1), ("y", 1, 1)]


def test_articles_with_a_stored_vector_are_not_sent_again(spark):
    rows = B.articles(spark, DATA).limit(40)
    path = new_path(spark, "embeddings")
    A.write_embeddings(E.embed(rows.filter("seq % 2 = 0"), "letters"), path)
    missing = A.not_embedded(rows, A.read_embeddings(spark, path, "letters"))
    assert sorted(r.seq for r in missing.collect()) == sorted(r.seq for r in rows.filter("seq % 2 = 1").collect())


def test_previous_episode_does_not_cross_gaps(spark):
    issues = spark.createDataFrame([("s", date(2026, 2, d)) for d in (7, 9)], "show string, issue_date date")
    told = spark.createDataFrame([("s", date(2026, 2, 6), "six")], "show string, date date, script string")
    found = {r.issue_date.day: r.previous_script for r in digests.previous_episode(issues, told).collect()}
    assert found == {7: "six", 9: "No previous episode found."}


def test_written_lines_keep_their_order(spark):
    clustered = B.labelled(spark, DATA)
    lines = digests.stories_digest(clustered, S.analyze(clustered, ISSUE))
    path = new_path(spark, "digest")
    digests.write_lines(lines, path)
    one = lines.filter("show = '0' and issue_date = date '2024-01-02'").orderBy("rank", "block", "row").select("line").collect()
    text = "\n".join(r.line for r in one)
    folder = spark.read.text(f"{path}/show=0/issue_date=2024-01-02", wholetext=True)
    parts = folder.select("value", F.col("_metadata.file_name").alias("f")).orderBy("f").collect()
    assert "".join(p.value for p in parts).rstrip("\n") == text.rstrip("\n")
    assert text.startswith("# Coverage Pulse - 2024-01-02\n\n## 1. ")


def test_view_dates(spark):
    rows = [("s", date(2026, 2, 7), i, "src", f"t{i}", "", "https://www.a.it/x", d, 1) for i, d in enumerate([DAY + "10:00:00 +0100", DAY + "12:00:00 GMT", "soon"])]
    df = spark.createDataFrame(rows, "show string, issue_date date, seq bigint, source string, title string, description string, link string, date string, cluster_id bigint")
    shown = {r.seq: (r.position, r.time_display) for r in views.card_articles(df).collect()}
    assert shown == {1: (1, "12:00"), 0: (2, "10:00"), 2: (3, "")}
    strict = {r.seq: (r.position, r.time_display) for r in views.card_articles(df, strict_view=True).collect()}
    assert strict == {0: (1, "10:00"), 1: (2, ""), 2: (3, "")}
    assert views.view_stats(df).first().clustered_pct == 100
    assert datetime(2026, 2, 7).weekday() == 5


def test_positions_by_key_equal_those_of_whole_rows(spark):
    rows = [("hot" if k % 3 else None, (k * 7919) % 1009, f"text {k}") for k in range(400)]
    df = spark.createDataFrame(rows, "place string, seq bigint, text string").repartition(5)
    whole = positions(df, ["place"], [F.col("seq")])
    late = positions(df, ["place"], [F.col("seq")], key=["seq"])
    assert late.columns == [*df.columns, "position"]
    assert sorted(map(repr, late.collect())) == sorted(map(repr, whole.collect()))
    assert positions(df.filter("seq < 0"), ["place"], [F.col("seq")], key=["seq"]).count() == 0


def test_hashing_writes_no_text_twice(spark, monkeypatch):
    """The counted table holds an article's texts once; the embedded text is put together from them where it is read."""
    written, write = [], E.materialize
    monkeypatch.setattr(E, "materialize", lambda df, name: written.append((name, df.columns)) or write(df, name))
    rows = spark.createDataFrame([(1, "red fox", None), (2, None, "a fox"), (3, "", "")], "seq long, title string, description string")
    found = E.embed_hashing(rows, 8)
    assert written == [("counted", ["seq", "title", "description", "_counts"])]
    assert found.columns == ["seq", "title", "description", "embedding_text", "embedding", "provider"]
    texts = {r.seq: r.embedding_text for r in E.with_embedding_text(rows).collect()}
    assert {r.seq: r.embedding_text for r in found.collect()} == texts
    again = E.embed_hashing(found, 8)
    assert again.columns == found.columns and sorted(map(repr, again.collect())) == sorted(map(repr, found.collect()))


def test_digest_joins_articles_with_ranks_alone(spark):
    """Long texts of stories don't count in the join of ranks with all articles, which then moves no article."""
    pick = np.random.default_rng(1)
    long = lambda: "".join(map(chr, pick.integers(33, 0x4E00, 9000)))
    rows = [("a", date(2026, 1, 1 + k // 40), k, f"s{k % 2}", f"t{k}", long(), "", k // 2, 0.0) for k in range(240)]
    schema = "show string, issue_date date, seq long, source string, title string, description string, link string, cluster_id long, distance double"
    clustered = E.materialize(spark.createDataFrame(rows, schema), "clustered")
    clusters = E.materialize(S.analyze(clustered, ISSUE).withColumn("category", F.lit("top")), "clusters")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "65536")
    try:
        lines = digests.stories_digest(clustered, clusters)
        assert "BroadcastHashJoin" in lines._jdf.queryExecution().executedPlan().toString()
        assert lines.filter("block = 2").count() == 240
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_task_holds_one_candidate_per_row(monkeypatch):
    """Each block of a pair of tiles offered a candidate per row, and all were held till the end."""
    from storyline.operators import nearest as N

    rng = np.random.default_rng(3)
    best, every = N.Best(50), []
    for _ in range(40):
        row = rng.permutation(50)[:30]
        partner, near, tie = rng.integers(0, 9, 30), rng.integers(0, 4, 30) / 4, rng.integers(0, 2, 30)
        best.offer(row, partner, partner, near, tie)
        every.append((row, partner, near, tie))
    row, place, partner, near, tie = best.found()
    assert len(best.near) == 50 and (place == partner).all()
    for one, other in zip(N.first_choices(*(np.concatenate(x) for x in zip(*every))), (row, partner, near, tie)):
        assert (one == other).all()
