"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import re
import time
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlight.llm import (
    decision_list, jaccard_join, length_histogram, mixing, pu_toxicity, skip_crf, snapshots, suffix_decontam, token_store, warc,
)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, `class` string, score double, size string, hit int, n_words string"


def rows_of(texts):
    return [(i, t, "en", s, len(t or ""), 1, "c", 0.5, "s", 2, "w") for i, t, s in texts]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    texts = [
        (1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, WORDS, "b"), (4, WORDS, "b"), (5, WORDS, "b"), (None, WORDS, None), (None, None, None),
        (6, "x" * 200_000, "a"), (7, long, "a"), (8, long + " more", "a"), (9, "Idiot you absolute idiot", "b"), (10, "a b", "c"),
    ]
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, WORDS), (1, WORDS), (2, None), (None, "a b"), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(9, 0, 1), (9, 0, 1), (4, 1, 0), (None, 1, 1), (5, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


def test_token_counts(odd, nothing):
    hist = {r.length: r for r in length_histogram.histogram(odd, TOKENIZER).collect()}
    assert hist[0].n_docs == 4 and sum(r.n_docs for r in hist.values()) == 13
    longest = hist[max(hist)]
    assert longest.docs_above == 0 and longest.truncated_total == sum(r.length * r.n_docs for r in hist.values())
    assert length_histogram.histogram(nothing, TOKENIZER).count() == 0
    cut = length_histogram.truncated_totals(length_histogram.histogram(odd, TOKENIZER), [0, 5]).collect()
    assert [r.truncated_total for r in cut] == [0, sum(min(r.length, 5) * r.n_docs for r in hist.values())]
    assert length_histogram.quantiles(length_histogram.histogram(odd, TOKENIZER), [0.1]).first().length == 0


def test_token_store(odd, nothing, tmp_path):
    token_store.write_store(odd, str(tmp_path / "s"), TOKENIZER)
    rows = token_store.stored_documents(odd, str(tmp_path / "s")).orderBy("start").collect()
    assert len(rows) == 13 and [r.doc_id for r in rows][:3] == [None, None, 1]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
    assert sum(r.by_key for r in rows) == 10
    asked = odd.sparkSession.createDataFrame([(4,), (4,), (77,), (None,), (-3,)], "doc_id long")
    assert [r.doc_id for r in token_store.lookup(asked, str(tmp_path / "s")).collect()] == [4]
    token_store.write_store(nothing, str(tmp_path / "e"), TOKENIZER)
    assert token_store.stored_documents(nothing, str(tmp_path / "e")).count() == 0
    assert token_store.lookup(asked, str(tmp_path / "e")).count() == 0


def test_toxicity(odd, nothing, labels):
    rows = pu_toxicity.score(odd, labels).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert pu_toxicity.score(nothing, labels).count() == 0
    assert pu_toxicity.without_toxic(odd, labels.limit(0)).count() == 13
    assert pu_toxicity.without_toxic(odd, labels).columns == odd.columns


def test_toxicity_sample_with_a_repeated_id(spark, labels):
    """An id on most rows is one document of either sample."""
    docs = spark.createDataFrame([(9 if i % 3 else i, f"text {i}") for i in range(300)], "doc_id long, text string")
    rows, _ = pu_toxicity.sample(docs, labels)
    assert sum(r.positive for r in rows.collect()) == 2 and rows.count() <= 2 + 101


def test_decontamination(odd, nothing, bench):
    rows = suffix_decontam.contamination(odd, bench).collect()
    found = sorted((r.doc_id or -1, r.n_words, r.n_hit, tuple(r["items"])) for r in rows if r.n_hit)
    assert found == [(-1, 12, 12, ("1",)), (4, 12, 12, ("1",)), (4, 12, 12, ("1",)), (5, 12, 12, ("1",)), (10, 2, 2, ("null",))]
    assert len(rows) == 13
    kept = suffix_decontam.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 8
    assert suffix_decontam.contamination(nothing, bench).count() == 0
    assert suffix_decontam.decontaminate(odd, bench.limit(0)).count() == 13
    assert suffix_decontam.longest_matches(odd, bench).where("n_words = 12").count() == 1


def test_equal_items_meet_a_hot_passage(spark):
    """Equal windows are listed once for all their items, so items times places are never spread out."""
    bench = spark.createDataFrame([(i, WORDS) for i in range(800)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join([WORDS] * 500)) for i in range(4)], "doc_id long, text string").coalesce(1)
    began = time.time()
    rows = suffix_decontam.contamination(docs, bench).collect()
    n = len(WORDS.split())
    assert [(r.doc_id, r.n_hit, len(r["items"])) for r in sorted(rows)] == [(i, 500 * n, 800) for i in range(4)]
    assert time.time() - began < 60


def test_quality(odd, nothing, labels):
    rows, rules = decision_list.judge(odd, labels)
    rows = rows.collect()
    assert len(rows) == 13 and rules == []
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert {r.doc_id for r in rows if r.kept} == {7, 8}
    assert decision_list.judge(nothing, labels)[0].count() == 0
    assert decision_list.judge(odd, labels.limit(0))[0].count() == 13


def test_personal_data(spark, odd, nothing):
    rows = skip_crf.detect(odd).collect()
    assert len(rows) == 13 and all(r.base == "" for r in rows)
    assert skip_crf.detect(nothing).count() == 0
    texts = spark.createDataFrame([(1, "a.b@c.de, 256.1.1.1 1.2.3.4 +1 (743) 555-3824 4111 1111 1111 1111 4111111111111112")], "doc_id long, text string")
    r = skip_crf.detect(texts).first()
    assert r.base == "email:0:8,ip:20:27"  # the phone and the card run into what follows them


def plain_spans(text):
    """The base patterns as they are stated."""
    whole = {
        0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = lambda s: "".join(c for c in s if c.isdigit())
    good = {
        0: lambda s: True, 1: lambda s: all(int(p) <= 255 for p in s.split(".")),
        2: lambda s: 14 <= len(digits(s)) <= 19 and skip_crf.luhn(digits(s)), 3: lambda s: 10 <= len(digits(s)) <= 15,
    }
    found = [(k, m.start(), m.end()) for k, p in whole.items() for m in re.finditer(p, text) if good[k](m[0])]
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


@given(st.text("ab1209.@-_+ ()é", max_size=60))
@settings(max_examples=3000, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert skip_crf.base_spans(text) == plain_spans(text)
    held = [m.span() for m in skip_crf.CANDIDATE.finditer(text)]
    assert held == [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if re.search("[0-9@]", m[0])]


@pytest.mark.parametrize("text", ["1" * 10**6, "1." * 500_000, "a" * 10**6 + "@", "a@" * 500_000, "a" * 10**6 + " 1", "+1(" * 300_000, "0" * 10**6 + "1.1.1.1"])
def test_long_runs_take_linear_time(text):
    began = time.process_time()
    spans = skip_crf.base_spans(text)
    skip_crf.nodes(text, spans)
    assert time.process_time() - began < 5
    assert len(spans) == (text.endswith("1.1.1.1") or 125_000 * text.startswith("1.1"))


def test_jaccard(odd, nothing):
    rows = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.join(odd).collect()}
    assert rows[4, 8] == rows[5, 8] == rows[None, 8] == 4
    assert rows[7, 19_996] == rows[8, 19_997] == 7
    assert rows[1, 0] == 1 and rows[2, 0] == 2 and rows[None, 0] is None and rows[6, 1] == 6 and rows[10, 1] == 10
    assert jaccard_join.join(nothing).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 7, 9, 10]


def test_one_of_each_with_repeated_ids(spark):
    """A doc_id may repeat with other texts: only copies go, and a null row is not document 42."""
    one, two, three = WORDS, " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(30))
    rows = [(1, one), (2, one), (2, two), (2, three), (2, three), (3, three + " more"), (42, "x y z"), (None, None), (None, None), (5, None), (5, ""), (5, ""), (None, two), (None, "lone words")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, one), (2, two), (2, three), (42, "x y z"), (None, None), (5, None), (5, ""), (None, "lone words")]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))
    near = [(7, three), (7, three + " more"), (8, three)]
    assert [r.doc_id for r in jaccard_join.one_of_each(spark.createDataFrame(near, "doc_id long, text string")).collect()] == [7]


def test_mixing(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 13 and all(0 <= r.taken <= 2 * r.size for r in rows)
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    assert mixing.mix(nothing).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r.taken for r in rows)
    assert mixing.mixed(nothing).count() == 0


def test_snapshots(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "bot", f"m{t}") for c, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for t in range(n)]
    turns += [(5, 0, None, None), (5, 0, None, None), (6, None, "user", "x"), (None, 0, "user", "m0"), (None, 0, "user", "lone")]
    rows = snapshots.collapse(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id if r.conv_id is not None else -1, r.n_turns) for r in rows) == [(-1, 1), (2, 4), (5, 1), (6, 1)]
    assert next(r.rendered for r in rows if r.conv_id == 5) == "<|im_start|>unknown\n<|im_end|>\n"
    assert snapshots.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    long = [(1, t, "user", f"t{t}") for t in range(700)] + [(2, t, "user", f"t{t}") for t in range(600)]
    assert [(r.conv_id, r.n_turns) for r in snapshots.collapse(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).collect()] == [(1, 700)]


def test_warc(spark):
    pages = [(1, "http://a/", "<title>T &amp; &#8364;</title><script>x<y</script><p>one<br>two <b>three</b></p><!-- no --><a href=\"/u\">link</a>"), (2, None, None), (None, "u", "")]
    pages = spark.createDataFrame(pages + pages[:1], "page_id long, url string, html string").withColumn("block", F.lit(1)).withColumn("text", F.lit("t"))
    source = warc.responses(pages)
    rows = warc.derive(source)
    found = rows.collect()
    text = next(r for r in found if r.page_id == 1 and r.warc_type == "conversion")
    meta = next(r for r in found if r.page_id == 1 and r.warc_type == "metadata")
    assert text.block == "T & €\none\ntwo three\nlink" and "outlink: /u\r\n" in meta.block and "title: T & €\r\n" in meta.block
    response = source.where("page_id = 1").first()
    assert text.refers_to == meta.refers_to == response.record_id and text.source_digest == response.payload_digest
    assert len(found) == 8
    for r in warc.serialized(rows).collect():
        head, _, rest = r.record.partition("\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert fields["WARC-Record-ID"] == r.record_id and rest.encode()[int(fields["Content-Length"]) :] == b"\r\n\r\n"
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_warc_link_forms_and_references(spark):
    """Values in double quotes, single quotes or bare; decimal, hexadecimal and named references."""
    html = """<a class=c href='/x?a=1&amp;b'>1</a> <A HREF=/y>2</A> <a href = "/z">3</a><p>&#x27;q&#X41;&#66;&#xD800;&lt; a & b</p>"""
    rows = warc.derive(warc.responses(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))).collect()
    meta, text = (next(r.block for r in rows if r.warc_type == k) for k in ("metadata", "conversion"))
    assert [x[9:] for x in meta.split("\r\n") if x.startswith("outlink: ")] == ["/x?a=1&b", "/y", "/z"]
    assert text == "1 2 3\n'qAB&#xD800;< a & b"


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, small, odd, nothing, name, step):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert step(spark, docs, small).columns == docs.columns
    assert step(spark, docs.limit(0), small).count() == 0


def test_one_of_each_keeps_every_column(spark):
    """Columns of the names that the work could use pass through; rows equal in id and text keep the same one in any order."""
    copies = [(1, WORDS, "b", 111, 7), (1, WORDS, "a", 112, 7), (2, WORDS, "c", 113, 7), (3, "x y z", "d", 114, None)]
    schema = "doc_id long, text string, source string, jaccard_id long, dropped_id long"
    kept = [sorted(map(tuple, jaccard_join.one_of_each(spark.createDataFrame(rows, schema)).collect())) for rows in (copies, copies[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 2
    assert set(kept[0]) < set(copies) and copies[3] in kept[0]


def test_texts_meet_long_lists_without_a_shuffle(spark, monkeypatch):
    """Only texts that seem to be on a list are sent to meet it; a bitmap that is full lets all pass and loses none."""
    lines = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(300)]
    docs = spark.createDataFrame([(i, lines[i % 290]) for i in range(300)] + [(None, "lone words")], "doc_id long, text string")
    listed = spark.range(20).select(F.xxhash64("id").alias("h"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bits in (1 << 26, 64):
            monkeypatch.setattr(jaccard_join, "SIEVE", bits, raising=False)
            asked = jaccard_join.join(docs).where("doc_id < 5").select("class", F.col("doc_id").alias("key"))
            rows = jaccard_join.class_rows(docs, asked, 5)
            below = rows._jdf.queryExecution().executedPlan().toString().partition("MapInArrow")[2].partition("class#")[2]
            assert "hashpartitioning(key#" not in below
            assert sorted(r["class"] for r in rows.collect()) == sorted(r["class"] for r in asked.collect())
            assert sorted(-1 if r.doc_id is None else r.doc_id for r in jaccard_join.one_of_each(docs).collect()) == [-1, *range(290)]
            passed = [r.doc_id for r in jaccard_join.sieved(docs, F.xxhash64("doc_id"), listed).where("perhaps").collect()]
            assert {*range(20)} <= {*passed} and (len(passed) == 20 if bits > 64 else len(passed) <= 301)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_toxicity_fit_leaves_the_driver_room(spark, small):
    """The fit holds a few counts a feature, not several wide arrays at once."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    tracemalloc.start()
    try:
        used, weights, bias = pu_toxicity.model(docs, labels)
        assert tracemalloc.get_traced_memory()[1] < 80e6
    finally:
        tracemalloc.stop()
    assert len(used) == len(weights) and bias > -30


def test_stages_send_texts_in_small_batches(spark, small):
    """Long texts reach a worker about 1 MB at a time, none is lost; the whole run leaves the session's bound as it was."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(conf)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    texts = spark.range(0, 240, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("many words "), 9_000).alias("text"))
    try:
        sent = corpus_pipeline.alone(lambda spark, docs, _: docs.mapInArrow(sizes, "n long, bytes long"))(spark, texts, small).collect()
        assert sum(r.n for r in sent) == 240 and max(r.bytes for r in sent) < 2e6
        spark.conf.set(conf, "50m")
        assert corpus_pipeline.run(spark, small).count()
        assert spark.conf.get(conf) == "50m"
    finally:
        spark.conf.set(conf, own)
