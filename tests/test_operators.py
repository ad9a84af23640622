"""Operators on small literal frames: edges that the oracle tables do not hold."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revlake.config import Config
from revlake.functions import dates as D
from revlake.functions import packed as PK
from revlake.functions import text as T
from revlake.operators import context as C
from revlake.operators import evaluation as E
from revlake.operators import jobs as J
from revlake.operators import leave as V
from revlake.operators import lifecycle as L
from revlake.operators import name_index as NI
from revlake.operators import pages as P
from revlake.operators import retrieval as R
from revlake.operators import sketches as SK
from revlake.operators import structure as S
from revlake.operators import text_index as X
from revlake.operators import vector_index as VI


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


def test_whitespace(spark):
    assert one(spark, "﻿a  b\r\n \r\n\n\n c​ ", T.normalize_whitespace) == "a b\n\nc"
    assert one(spark, " ​ ", T.normalize_whitespace) == ""
    assert one(spark, "proce-\ndure A-\nb", T.dehyphenate) == "procedure A-\nb"


@pytest.mark.parametrize(
    "line, level",
    [("## Scope", 2), ("3.2 Approval Requirements", 3), ("3. of the amount is due.", 0), ("GENERAL PROVISIONS", 2), ("Approval Requirements", 2), ("Rules of the House", 2), ("Owner: Finance Director", 0), ("This is a sentence.", 0), ("", 0), ("Version 3", 0), ("X" * 130, 0)],
)
def test_headings(spark, line, level):
    assert one(spark, line, T.heading_level) == level


def test_codes_and_answers(spark):
    assert one(spark, "see fin-pol-001, FIN-POL-001 and x-1", T.extract_codes) == ["FIN-POL-001"]
    assert one(spark, "ORA-01555 ora-01555", T.extract_error_codes) == ["ORA-01555"]
    assert one(spark, "what about it?", lambda c: T.needs_rewrite(c, F.lit(True))) is True
    assert one(spark, "what about it?", lambda c: T.needs_rewrite(c, F.lit(False))) is False
    assert one(spark, "the limit is 27,500 USD", lambda c: T.contains_fact(c, F.lit("$27500"))) is True
    assert one(spark, "as [2] says", lambda c: T.used_citations(c, F.array(F.lit(1), F.lit(2), F.lit(3)))) == [2]
    assert one(spark, "as [9] says", lambda c: T.used_citations(c, F.array(F.lit(1), F.lit(2)))) == [1, 2]
    assert one(spark, '"Question: how?"', lambda c: T.clean_rewrite(c, F.lit("f"))) == "how?"
    assert one(spark, "IT-guide-1", T.type_from_code) == "GUIDELINE"
    assert one(spark, "travel_POLICY-v2.final.pdf", T.title_from_file) == "Travel POLICY V2.final"


def test_dates(spark):
    f = spark.createDataFrame([("2024-02-29", -0.25), ("2023-01-31", 2.75)], "d string, x double").withColumn("day", F.to_date("d"))
    rows = f.select(F.add_months("day", 1), D.iso_weekday(F.col("day")), D.round_half_day(F.col("x")), D.valid_date(F.col("d"))).collect()
    assert [tuple(r) for r in rows] == [(dt.date(2024, 3, 29), 4, 0.0, True), (dt.date(2023, 2, 28), 2, 3.0, True)]
    assert one(spark, "2023-02-29", D.valid_date) is False


def test_activation_keeps_exactly_one_current(spark):
    rows = [(1, 1, "READY"), (1, 2, "READY"), (1, 3, "FAILED"), (2, 1, "PENDING"), (3, 2, "SUPERSEDED"), (3, 1, "READY")]
    got = L.activate(spark.createDataFrame(rows, "document_id long, revision_number int, status string"))
    assert {(r.document_id, r.revision_number) for r in got.filter("is_current").collect()} == {(1, 2), (3, 2)}
    assert [(r.document_id, r.n_current) for r in L.current_violations(got).collect()] == [(2, 0)]


def test_cyclic_groups(spark):
    got = L.effective_principals(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("u", "a")], "child string, parent string"))
    assert {r.ancestor for r in got.filter("child = 'u'").collect()} == {"a", "b", "c"}


def test_long_chains_of_groups(spark):
    got = L.effective_principals(spark.createDataFrame([(k, k + 1) for k in range(60)], "child long, parent long"))
    assert {r.ancestor for r in got.filter("child = 0").collect()} == set(range(1, 61))
    assert got.count() == 60 * 61 // 2


def test_claims_and_upserts(spark):
    now = F.to_timestamp(F.lit("2024-01-01 10:00:00"))
    revs = spark.createDataFrame([(1, "PENDING", 1, None), (2, "PENDING", 0, "w0"), (3, "READY", 4, "w0")], "revision_id long, status string, attempts int, claimed_by string").withColumn("created_at", now)
    assert [(r.revision_id, r.status, r.attempts, r.claimed_by) for r in L.claim_pending(revs, 1, "w9", now).collect()] == [(1, "PROCESSING", 2, "w9")]
    failed = L.apply_failures(revs, spark.createDataFrame([(2, "FAILED", None)], "revision_id long, outcome string, error string")).orderBy("revision_id").collect()
    assert [(r.status, r.claimed_by) for r in failed] == [("PENDING", None), ("FAILED", None), ("READY", "w0")]
    jobs = spark.createDataFrame([(1, "RUNNING", "2024-01-01 09:00:00", None), (2, "RUNNING", "2024-01-01 09:50:00", None), (3, "COMPLETED", "2024-01-01 01:00:00", "x")], "job_id int, status string, s string, error_summary string")
    jobs = jobs.select("job_id", "status", F.to_timestamp("s").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), "error_summary")
    assert [r.status for r in L.fail_abandoned(jobs, now).orderBy("job_id").collect()] == ["FAILED", "RUNNING", "COMPLETED"]
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "code string, id int, title string").withColumn("updated_at", F.to_timestamp(F.lit("2020-01-01")))
    new = spark.createDataFrame([("a", 9, "x"), ("b", 9, "new"), ("d", 4, "w")], "code string, id int, title string")
    got = {r.code: (r.id, r.title, r.updated_at.year) for r in L.upsert(old, new, "code", ("id",), now).collect()}
    assert got == {"a": (1, "x", 2020), "b": (2, "new", 2024), "c": (3, "z", 2020), "d": (4, "w", 2024)}


def test_citations_and_metadata_of_messages(spark):
    m = spark.createDataFrame([(1, 1, "q", {"a": "1", "b": "2"}), (1, 2, "", None)], "conv_id int, turn int, text string, metadata map<string,string>")
    cited = spark.createDataFrame([(1, 2, 2, "y"), (1, 2, 1, "x")], "conv_id int, turn int, citation int, excerpt string")
    answers = spark.createDataFrame([(1, 2, "ans", "ANSWERED", {"b": "3"})], "conv_id int, turn int, answer string, label string, metadata map<string,string>").join(C.snapshot_citations(cited, "conv_id", "turn"), ["conv_id", "turn"])
    got = C.finalise_messages(m, answers).orderBy("turn").collect()
    assert [(r.text, r.answer_status, r.metadata) for r in got] == [("q", "NONE", {"a": "1", "b": "2"}), ("ans", "ANSWERED", {"b": "3"})]
    assert got[0].citations is None and [(c.citation, c.excerpt) for c in got[1].citations] == [(1, "x"), (2, "y")]


def test_rank_fusion(spark):
    schema = "query_id long, chunk_id long, rank int, score double"
    a = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8)], schema)
    b = spark.createDataFrame([(1, 11, 1, 5.0), (1, 12, 2, 4.0), (2, 13, 1, 1.0)], schema)
    got = R.rrf({"a": a, "b": b}, {}).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, 11), (1, 10), (1, 12), (2, 13)]
    assert got[3].score == pytest.approx(1 / 61) and got[0].n_lists == 2 and got[0].ranks == {"a": 2, "b": 1}
    with pytest.raises(ValueError):
        R.rrf({"a": a}, {}, 0)
    twice = R.rrf({"a": a.unionByName(spark.createDataFrame([(1, 11, 7, 0.1)], schema)), "b": b}, {}).filter("chunk_id = 11").first()
    assert twice.ranks == {"a": 2, "b": 1} and twice.n_lists == 2 and twice.source_scores == {"a": 0.8, "b": 5.0}


@pytest.fixture(scope="module")
def small_index(spark, tmp_path_factory):
    rows = [(1, "AB-CD-1", "T", None, "red green blue"), (2, "AB-CD-1", "T", "olive", "green red"), (3, "AB-CD-2", "red T", None, "green"), (4, "AB-CD-2", "T", None, "yellow")]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_code string, section_title string, subsection_title string, content string")
    return X.store_index(chunks, str(tmp_path_factory.mktemp("index")))


def found(spark, index, q, **more):
    return [r.chunk_id for r in X.lexical_topk(spark.createDataFrame([(1, q)], "query_id long, query string"), index, 9, **more).orderBy("rank").collect()]


@pytest.mark.parametrize(
    "q, want",
    [("red green", [3, 1, 2]), ('"red green"', [1]), ("green -blue", [2, 3]), ("red missing", []), ("yellow or blue", [1, 4]), ('olive or "green blue" or cd -t', [1, 2]), ("ab-cd-2", [3, 4]), ("", []), ("Red RED", [3, 1, 2])],
)
def test_lexical_syntax(spark, small_index, q, want):
    assert found(spark, small_index, q) == want


def test_lexical_parts_of_common_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SLOT_CHUNKS", 3)
    monkeypatch.setattr(X, "PART_SLOTS", 1)
    rows = [(k, "X-Y-1", "title", None, f"common w{k} other" if k % 2 else f"common w{k}") for k in range(20)]
    index = X.store_index(spark.createDataFrame(rows, "chunk_id long, document_code string, section_title string, subsection_title string, content string"), str(tmp_path))
    common = index.blocks().filter("term = 'common'")
    assert common.select("slot").distinct().count() > 3 and common.select("bucket").distinct().count() > 1
    assert sorted(found(spark, index, "common other")) == [k for k in range(20) if k % 2][:9]
    assert found(spark, index, "common w7") == [7] and found(spark, index, "common w7 -other") == []


CHUNKS = "chunk_id long, revision_id long, document_code string, section_title string, subsection_title string, content string"


def some_chunks(rng, revisions):
    words = [f"w{k}" for k in range(40)]
    weights = [1 / (k + 1) for k in range(40)]
    pick = lambda n: " ".join(rng.choices(words, weights, k=n))
    return [(r * 1000 + k, r, f"AB-CD-{r}", pick(2), rng.choice([None, pick(1)]), pick(rng.randrange(1, 12))) for r in revisions for k in range(rng.randrange(1, 9))]


def by_brute_force(rows, queries, k):
    out = []
    for query_id, q in queries:
        found = []
        for chunk_id, _, code, title, sub, content in rows:
            has = Counter()
            for text, weight in ((code, 1.0), (title, 1.0), (sub, 0.4), (content, 0.2)):
                for w in re.findall("[a-z0-9]+", (text or "").lower()):
                    has[w] += weight
            if all(w in has for w in q.split()):
                r = sum(has[w] for w in set(q.split()))
                found.append((-round(r / (r + 1), 9), chunk_id))
        out += [(query_id, c, n + 1, -s) for n, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


def lexical(spark, index, queries, k, **more):
    got = X.lexical_topk(spark.createDataFrame(queries, "query_id long, query string"), index, k, **more)
    return sorted((r.query_id, r.chunk_id, r["rank"], round(r.score, 9)) for r in got.collect()), got


def test_slots_below_the_floor_are_not_searched(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SLOT_CHUNKS", 12)
    rng = random.Random(2)
    rows = some_chunks(rng, range(60))
    # one chunk that no other can reach, in a question whose words stand everywhere
    rows += [(99_000 + k, 99, "w0 w1", "w0 w0 w1", "w0", "w0 w1 w0") for k in range(3)]
    index = X.store_index(spark.createDataFrame(rows, CHUNKS), str(tmp_path))
    queries = [(n, " ".join(q)) for n, q in enumerate([["w0"], ["w0", "w1"], ["w3", "w0"], ["w30"], ["w5", "w7", "w1"], ["w38", "w39"], ["nothing"]])]
    assert lexical(spark, index, queries, 3)[0] == by_brute_force(rows, queries, 3)
    got, df = lexical(spark, index, queries, 1, counts=True)
    assert got == by_brute_force(rows, queries, 1)
    first = df.filter("query_id = 1").first()
    assert first.slots_searched < first.slots_with_terms
    many, _ = lexical(spark, index, queries, 500)
    assert many == by_brute_force(rows, queries, 500)


def test_postings_are_read_by_bucket(spark, tmp_path, capsys):
    index = X.store_index(spark.createDataFrame(some_chunks(random.Random(1), range(9)), CHUNKS), str(tmp_path))
    bucket = spark.range(1).select(X.bucket_of(F.lit("w0"), F.lit(0))).first()[0]
    index.blocks().filter(F.col("bucket").isin([bucket])).explain("formatted")
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", capsys.readouterr().out)


def test_an_index_that_is_kept_up_equals_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SLOT_CHUNKS", 50)
    rng = random.Random(4)
    rows = some_chunks(rng, range(80))
    index = X.store_index(spark.createDataFrame(rows, CHUNKS), str(tmp_path / "a"))
    written = lambda: sum(f.stat().st_size for f in (tmp_path / "a").rglob("*.parquet"))
    whole = written()
    queries = [(n, f"w{a} w{b}") for n, (a, b) in enumerate([(0, 1), (2, 0), (5, 3), (9, 1), (20, 0)])]
    for turn, revisions in enumerate([[3], [3, 5], [70, 200], [5]]):
        new = some_chunks(rng, [r for r in revisions if (turn, r) != (3, 5)])  # at last revision 5 has no chunks
        rows = [r for r in rows if r[1] not in revisions] + new
        before = written()
        X.replace_revisions(index, spark.createDataFrame([(r,) for r in revisions], "revision_id long"), spark.createDataFrame(new, CHUNKS))
        assert written() - before < whole / 2
        assert lexical(spark, index, queries, 9)[0] == by_brute_force(rows, queries, 9)
    rebuilt = X.store_index(spark.createDataFrame(rows, CHUNKS), str(tmp_path / "b"))
    postings = lambda i: sorted((r.term, r.chunk_id, round(r.weight, 9), r.tf, tuple(r.positions)) for r in i.postings.collect())
    assert postings(index) == postings(rebuilt)
    assert len(index.segments()) == 4
    largest = max(X.sizes(index), key=X.sizes(index).get)
    monkeypatch.setattr(X, "SEGMENTS", 3)
    X.merge_segments(index)
    assert len(index.segments()) == 2 and largest in index.segments()
    assert postings(index) == postings(rebuilt)
    X.merge_segments(index, list(index.segments()))
    assert len(index.segments()) == 1 and postings(index) == postings(rebuilt)
    assert sorted(map(tuple, index.terms.collect())) == sorted(map(tuple, rebuilt.terms.collect()))
    assert lexical(spark, index, queries, 9)[0] == by_brute_force(rows, queries, 9)


def test_chunks_of_long_documents_have_ids_of_their_own(spark, tmp_path):
    from revlake.sources import adapters as A

    docs = [(0, "\n".join(map(str, range(100_002)))), (1, "a\nb"), (900_000, "x"), (3 * 6_760_000, "y")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    chunks = A.chunks(spark, str(tmp_path))
    assert chunks.count() == 100_006 == chunks.select("chunk_id").distinct().count()
    codes = {r.revision_id: r.document_code for r in chunks.select("revision_id", "document_code").distinct().collect()}
    assert codes == {0: "DOC-AA-0000", 1: "DOC-AA-0000", 900_000: "DOC-BE-0000", 3 * 6_760_000: "DOC-BAA-0000"}


def test_cover_density(spark, tmp_path):
    rows = [(1, None, None, None, "red x x x x x green"), (2, None, None, None, "x red green x"), (3, None, None, None, "red green red")]
    index = X.store_index(spark.createDataFrame(rows, "chunk_id long, document_code string, section_title string, subsection_title string, content string"), str(tmp_path))
    got = X.lexical_topk(spark.createDataFrame([(1, "red green")], "query_id long, query string"), index, 9, rank="cover").orderBy("rank").collect()
    # a stretch of two hits of weight 0.2 counts 0.2, over one and the words between; the third chunk holds two
    assert [(r.chunk_id, r.score) for r in got] == [(3, pytest.approx(0.4 / 1.4)), (2, pytest.approx(0.2 / 1.2)), (1, pytest.approx(0.2 / 6 / (1 + 0.2 / 6)))]


def test_stop_words_and_stems(spark, tmp_path):
    rows = [(1, None, None, None, "the walking dogs"), (2, None, None, None, "a walked dog")]
    index = X.store_index(spark.createDataFrame(rows, "chunk_id long, document_code string, section_title string, subsection_title string, content string"), str(tmp_path), ("the", "a"), True)
    assert found(spark, index, "the walks") == [1, 2] and index.terms.filter("term in ('the', 'a')").count() == 0


def test_dense_topk_of_many_queries(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    m[7] = m[3]
    rows = spark.createDataFrame([(i, m[i].tolist(), i % 3) for i in range(300)], "id long, vector array<double>, kind int")
    asked = rows.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    want = {(q, k + 1, int(i)) for q in range(0, 300, 10) for k, i in enumerate(sorted((i for i in range(300) if i % 3 == q % 3), key=lambda i: (-round(m[q] @ m[i] / np.linalg.norm(m[q]) / np.linalg.norm(m[i]), 9), i))[:4])}
    for most in (4096, 7):
        monkeypatch.setattr(R, "MOST_QUERIES", most)
        monkeypatch.setattr(R, "TILE_ROWS", 64)
        assert {(r.query_id, r["rank"], r.id) for r in R.vector_topk(asked, rows, 4, same="kind").collect()} == want


def test_vector_topk_with_null_and_zero(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, vector array<float>")
    got = [(r.query_id, r.id, round(r.score, 4)) for r in R.vector_topk(q, v, 3).orderBy("rank").collect()]
    assert got == [(7, 1, 1.0), (7, 5, 0.7071), (7, 2, 0.0)]
    assert R.vector_topk(q.filter("vector is null"), v, 3).count() == 0


def shuffled(spark, run):
    """Bytes that run shuffles."""
    store, array = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        stages = store.stageList(None, False, False, array, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_near_duplicates_that_share_few_rare_words(spark):
    """Texts that have only a rare word or two in common are no candidates, so their word sets are not sent to one another."""
    rng = random.Random(5)
    texts = [(i, f"rare {' '.join(rng.sample([f'w{k}' for k in range(4000)], 200))}") for i in range(300)]
    texts += [(1000 + i, t + " more") for i, t in texts[:20]]
    df = spark.createDataFrame(texts, "id long, text string")
    found, known = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, lambda: found.extend(R.near_duplicates(df, 0.8).collect())) < 5_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert sorted((r.a, r.b) for r in found) == [(i, 1000 + i) for i in range(20)]


@pytest.mark.parametrize("tile", [1_000_000, 50])
def test_a_family_of_near_duplicates_is_sent_by_texts_not_by_pairs(spark, monkeypatch, tile):
    for name in ("TILE_PAIRS", "BIN_PAIRS", "BIN_SETS"):
        monkeypatch.setattr(R, name, tile)
    rng = random.Random(6)
    texts = []
    base = [f"w{k}" for k in range(150)]
    for i in range(250):
        own = rng.sample(base, rng.randrange(135, 150)) + [f"x{rng.randrange(500)}" for _ in range(rng.randrange(15))]
        texts.append((rng.randrange(10**6) * 1000 + i, " ".join(own)))
    texts += [(-5, texts[0][1]), (texts[3][0], texts[3][1]), (None, "alone")]
    df = spark.createDataFrame(texts, "id long, text string")
    sets = {}
    for i, t in texts:
        if i is not None:
            words = frozenset(t.split())
            sets[words] = min(i, sets.get(words, i))
    want = {}
    for x, a in sets.items():
        for y, b in sets.items():
            if a < b and len(x & y) / len(x | y) >= 0.8:
                want[a, b] = len(x & y) / len(x | y)
    found, known = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = shuffled(spark, lambda: found.extend(R.near_duplicates(df, 0.8).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert {(r.a, r.b): r.jaccard for r in found} == want and len(found) == len(want) > 10_000
    assert sent < 1_800_000 or tile == 50


def test_search_ships_only_the_blocks_that_a_question_asks_for(spark, tmp_path, monkeypatch):
    """Every question searches slots of its own; a slot's blocks of other questions' terms stay where they are."""
    monkeypatch.setattr(X, "SLOT_CHUNKS", 64)
    n = 60
    rows = [(k, "c", "s", None, " ".join([f"w{t}" for t in range(n)] + [f"w{k // 50}"] * 9 * (k % 50 == 0))) for k in range(50 * n)]
    index = X.store_index(spark.createDataFrame(rows, "chunk_id long, document_code string, section_title string, subsection_title string, content string"), str(tmp_path / "index"))
    asked = spark.createDataFrame([(t, f"w{t}") for t in range(n)], "query_id long, query string")
    found = []
    assert shuffled(spark, lambda: found.extend(X.lexical_topk(asked, index, 1).collect())) < 250_000
    assert sorted((r.query_id, r.chunk_id) for r in found) == [(t, 50 * t) for t in range(n)]


def test_postings_as_bytes(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**62, 500) >> rng.integers(0, 62, 500)
    assert (PK.numbers(PK.varints(values)[0]) == values).all() and len(PK.numbers(PK.varints(values[:0])[0])) == 0
    for turn in range(20):
        n = rng.integers(1, 9, 5)
        chunk = (rng.integers(-3, 4, n.sum()) << 30) + rng.integers(0, 2**30 if turn % 2 else 5, n.sum())
        counts = rng.integers(0, 3, (n.sum(), 4)) * (turn > 0) * rng.choice([1, 1, 7, 20_000][: 3 + (turn < 3)], (n.sum(), 4))
        place = np.concatenate([np.sort(rng.integers(0, 2**29, c)) for c in counts.ravel()])
        postings, places = PK.Postings(n, chunk, counts, place).packed()
        for a, b in ((0, 5), (1, 3)):
            x, y = n[:a].sum(), n[:b].sum()
            own = PK.unpacked(n[a:b], PK.bytes_of(postings.slice(a, b - a)), PK.bytes_of(places.slice(a, b - a)))
            first, last = counts[:x].sum(), counts[:y].sum()
            assert (own.chunk == chunk[x:y]).all() and (own.counts == counts[x:y]).all() and (own.place == place[first:last]).all()
    rows = spark.createDataFrame([(int(v),) for v in [*values, -1, 0, -(2**63), 2**63 - 1]], "v long")
    assert all(r.h == PK.xxhash64(np.array([r.v]))[0] for r in rows.select("v", F.xxhash64("v").alias("h")).collect())


def test_an_index_takes_little_room(spark, tmp_path):
    # long titles stand in every chunk of a revision; no posting is shuffled to be read where no chunk is dead
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for r in range(300):
        title = " ".join(rng.choices(words, k=30))
        rows += [((r << 30) + k, r, f"AB-CD-{r}", title, None, " ".join(rng.choices(words, k=10))) for k in range(10)]
    chunks, index = spark.createDataFrame(rows, CHUNKS), []
    n = 300 * 10 * 43  # of 3 words of the code, 30 and 10
    assert shuffled(spark, lambda: index.append(X.store_index(chunks, str(tmp_path)))) < 9 * n
    assert sum(f.stat().st_size for f in tmp_path.rglob("blocks/*/*.parquet")) < 4.5 * n
    counted = lambda: index[0].postings.select("tf").write.format("noop").mode("overwrite").save()
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, counted) < 10_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_dead_chunks_are_sent_or_met(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(X, "SLOT_CHUNKS", 20)
    monkeypatch.setattr(X, "MOST_SENT", most)
    rng = random.Random(8)
    rows = some_chunks(rng, range(30))
    index = X.store_index(spark.createDataFrame(rows, CHUNKS), str(tmp_path))
    new = some_chunks(rng, [4, 5])
    X.replace_revisions(index, spark.createDataFrame([(4,), (5,), (6,)], "revision_id long"), spark.createDataFrame(new, CHUNKS))
    rows = [r for r in rows if r[1] not in (4, 5, 6)] + new
    words = lambda r: Counter(re.findall("[a-z0-9]+", " ".join(x.lower() for x in r[2:] if x)))
    want = sorted((w, r[0], n) for r in rows for w, n in words(r).items())
    told = lambda: sorted((r.term, r.chunk_id, r.tf) for r in index.read_postings(placed=False).collect())
    queries = [(1, "w0 w1"), (2, "w3 w0")]
    assert told() == want and lexical(spark, index, queries, 9)[0] == by_brute_force(rows, queries, 9)
    X.merge_segments(index, list(index.segments()))
    assert told() == want and len(index.segments()) == 1


def test_near_duplicates_by_brute_force(spark):
    texts = ["a b c d e", "a b c d f", "a b c d e", "x y", "y x", "", None, "a b c d e g"]
    got = {(r.a, r.b) for r in R.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 0.6).collect()}
    assert got == {(0, 1), (0, 7), (1, 7)} - {(1, 7)} | ({(1, 7)} if 4 / 7 >= 0.6 else set())


def test_context_folds(spark):
    hits = spark.createDataFrame(
        [(1, 1, 0.9, 10, 1, 0, "s", "a b c d", 100), (1, 2, 0.8, 11, 1, 1, "s", "a b c d e f g h", 5900), (1, 3, 0.7, 10, 1, 0, "s", "a b c d", 100), (1, 4, 0.6, 12, 2, 5, "s", "q r s", 50), (1, 5, 0.5, 13, 1, 2, "s", "zz", 20)],
        "query_id long, rank int, score double, chunk_id long, revision_id long, chunk_index int, section_title string, content string, tokens int",
    )
    kept = C.dedupe_candidates(hits)
    assert [r.chunk_id for r in kept.orderBy("rank").collect()] == [10, 11, 12, 13]
    assert [(r.chunk_id, r.citation) for r in C.fit_context(kept).orderBy("citation").collect()] == [(10, 1), (12, 2), (13, 3)]
    merged = C.merge_adjacent(kept.withColumn("tokens", F.lit(10)))
    assert [(r.chunk_id, r.first_index, r.chunk_index, r.tokens) for r in merged.orderBy("rank").collect()] == [(10, 0, 2, 30), (12, 5, 5, 10)]


def test_elements(spark):
    text = "# Title\n\nFirst line\nsecond line\n- one\ncontinues here\n- two\n\n1. do it.\n| a | b |\n|---|---|\n| 1 | 2 |\nx    y    z\nq    r    s\nlast   lone   row"
    rows = S.build_elements(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert [(r.type, r.text, r["items"], r["rows"]) for r in rows] == [
        ("heading", "Title", None, None), ("paragraph", "First line second line", None, None), ("list", None, ["one continues here", "two"], None), ("list", None, ["do it."], None),
        ("table", None, None, [["a", "b"], ["1", "2"]]), ("table", None, None, [["x", "y", "z"], ["q", "r", "s"], ["last", "lone", "row"]]),
    ]
    shown = S.elements_to_text(spark.createDataFrame(rows), "doc_id").first().text
    assert "| a | b |\n| --- | --- |\n| 1 | 2 |" in shown and "1. do it." in shown


def test_html(spark):
    page = "<html><script>x</script><h1>T &amp; U</h1>loose<div><p>one<br>two</p><ol><li>a</li><li>b</li></ol><ul><li>c</li><li><p>d</p></li></ul></div><table><tr><th>h</th><th>i</th></tr><tr><td><p>1</p></td><td>2</td></tr></table><li>alone</li>"
    got = S.parse_html(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).collect()
    assert [(r.page_id, r.position, r.type, r.level, r.text, r["items"], r.ordered, r["rows"]) for r in got] == [
        (1, 0, "heading", 1, "T & U", None, None, None), (1, 1, "paragraph", None, "one two", None, None, None), (1, 2, "list", None, None, ["a", "b"], True, None), (1, 3, "list", None, None, ["c", "d"], False, None),
        (1, 4, "table", None, None, None, None, [["h", "i"], ["1", "2"]]), (1, 5, "paragraph", None, "- alone", None, None, None),
    ]


BLOCKS = "revision_id long, position int, section string, subsection string, role string, kind string, text string, page int"


def test_chunks_keep_bounds(spark):
    cfg = Config(chunk_target=200, chunk_max=300, chunk_min=40, chunk_overlap=20, parent_max=900)
    long = " ".join(f"Sentence number {k} says something useful." for k in range(60))
    table = "\n".join(["| h1 | h2 |", "| --- | --- |", *[f"| row {k} | {'v' * 60} |" for k in range(60)]])
    rows = [("A", None, "CONTENT", "paragraph", "tiny", 1), ("B", "b", "CONTENT", "paragraph", "small too", 2), ("C", None, "CONTENT", "paragraph", long, 3), ("D", None, "CONTENT", "table", table, 4), ("E", None, "CONTENT", "paragraph", "last", 5), ("F", None, "ADMINISTRATIVE", "paragraph", "history", 6)]
    got = S.chunk(spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], BLOCKS), cfg).orderBy("chunk_index").collect()
    children = [r for r in got if r.chunk_type == "CHILD"]
    assert all(r.tokens <= cfg.chunk_max + cfg.chunk_overlap + 40 for r in children)
    # small sections join small ones only, under their titles
    assert (children[0].content, children[0].path, children[0].subsection, children[0].page_start, children[0].page_end) == ("A\ntiny\n\nB\nsmall too", "A | B", None, 1, 2)
    assert [(r.section, r.content, r.role) for r in children[-2:]] == [("E", "last", "CONTENT"), ("F", "history", "ADMINISTRATIVE")]
    parts = [r for r in children if r.section == "D"]
    assert len(parts) > 1 and all("| h1 | h2 |" in r.content for r in parts)
    parents = {r.chunk_index: r.section for r in got if r.chunk_type == "PARENT"}
    assert set(parents.values()) == {"C", "D"} and all(parents[r.parent_index] == r.section for r in children if r.section in "CD")
    assert [r.parent_index for r in children if r.section not in "CD"] == [None, None, None]


def test_chunks_of_one_section(spark):
    cfg = Config(chunk_target=30, chunk_max=60, chunk_min=10, chunk_overlap=8, parent_max=40)
    say = lambda n, w: " ".join([w] * n) + "."
    texts = [say(10, "aaaa"), say(12, "bbbb"), say(14, "cccc"), say(3, "dd")]  # 14, 16, 19 and 3 tokens
    rows = [(1, k, "S", "sub", "CONTENT", "paragraph", t, k + 1) for k, t in enumerate(texts)]
    got = S.chunk(spark.createDataFrame(rows, BLOCKS), cfg).orderBy("chunk_index").collect()
    assert [(r.chunk_type, r.path, r.page_start, r.page_end, r.parent_index) for r in got] == [("PARENT", "S > sub", 1, 4, None), ("CHILD", "S > sub", 1, 2, 0), ("CHILD", "S > sub", 3, 4, 0)]
    assert got[1].content == "\n\n".join(texts[:2])
    assert got[2].content == "\n\n".join(texts[2:])  # the sentence before is over the overlap, and the short end is packed along
    assert got[0].tokens <= 40


def test_gold_questions(spark):
    facts = [(1, 1, "limit", "5", True), (1, 2, "limit", "6", True), (1, 2, "term", "9", False), (2, 1, "limit", "7", True), (3, 1, "limit", "8", True), (4, 1, "limit", "8", True)]
    docs = [(1, "D-1", True, "h1"), (2, "D-2", False, "h2"), (3, "D-3", True, "h3"), (4, "D-4", True, "h3")]
    got = E.build_gold(spark.createDataFrame(facts, "document_id int, revision_number int, fact string, value string, rendered boolean"), spark.createDataFrame(docs, "document_id int, document_code string, is_active boolean, content_hash string"), spark.createDataFrame([(f"n{k}",) for k in range(9)], "question string"))
    assert sorted((r.question, r.expected, r.old_value) for r in got.collect() if r.document_code) == [("D-1:limit", "6", "5"), ("D-3:limit", "8", None)]
    assert got.filter("document_code is null").count() == 4


def test_no_figures_of_vectors_without_meaning(spark):
    vectors = spark.createDataFrame([(True,), (False,)], "is_semantic boolean")
    with pytest.raises(ValueError):
        E.evaluate_retrieval(None, None, vectors)
    gold = spark.createDataFrame([(1, "fact", None, None, "x")], "query_id long, question_type string, expected_code string, expected_revision int, expected_section string")
    hits = spark.createDataFrame([], "query_id long, rank int, document_code string, revision_number int, is_current boolean, section_title string")
    assert E.evaluate_retrieval(gold, hits, vectors, allow_non_semantic=True).first().semantic is False
    assert E.evaluate_retrieval(gold, hits, vectors.filter("is_semantic")).first().semantic is True


def test_metrics_of_no_answer_gold(spark):
    gold = spark.createDataFrame([(1, "none", None, None, "x")], "query_id long, question_type string, expected_code string, expected_revision int, expected_section string")
    hits = spark.createDataFrame([], "query_id long, rank int, document_code string, revision_number int, is_current boolean, section_title string")
    r = E.summarise_retrieval(E.evaluate_retrieval(gold, hits)).first()
    assert (r.questions, r.answerable, r.recall_1, r.mrr, r.no_answer_accuracy) == (1, 0, 0.0, 0.0, 1.0)
    empty = E.latency_summary(spark.createDataFrame([], "v double"), "v").first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0)


def test_jobs(spark):
    assert J.cost_guard(spark.range(10), 10).count() == 10
    with pytest.raises(ValueError):
        J.cost_guard(spark.range(11), 10)
    texts = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "chunk_id long, content string")
    got = {r.chunk_id: r.embedding for r in J.hash_embed(texts).collect()}
    assert got[2][0] == got[3][0] == 1.0 and sum(x * x for x in got[1]) == pytest.approx(1)
    with pytest.raises(Exception, match="other vectors"):
        J.embed(texts, lambda t: [[0.0]] * (len(t) - 1), 1).collect()
    calls = [("t", 1, "apply", True, "x"), ("t", 2, "validate", False, "x"), ("t", 3, "validate", True, "x"), ("t", 4, "apply", True, "x"), ("t", 5, "apply", True, "x")]
    audited = J.audit_tool_calls(spark.createDataFrame(calls, "turn_id string, seq int, tool string, ok boolean, signature string")).orderBy("seq")
    assert [r.verdict for r in audited.collect()] == ["MISSING_PREREQUISITE", "ALLOWED", "ALLOWED", "ALLOWED", "DUPLICATE"]


def test_leave_days(spark):
    d = dt.date
    rows = [(1, d(2023, 12, 23), d(2023, 12, 27), "FULL_DAY", "FULL_DAY"), (2, d(2024, 2, 29), d(2024, 2, 29), "MORNING", "AFTERNOON"), (3, d(2024, 3, 4), d(2024, 3, 8), "AFTERNOON", "MORNING"), (4, d(2024, 3, 2), d(2024, 3, 3), "MORNING", "FULL_DAY"), (5, d(2024, 3, 9), d(2024, 3, 4), "FULL_DAY", "FULL_DAY")]
    f = spark.createDataFrame([(*r, [1, 2, 3, 4, 5]) for r in rows], "request_id int, start_date date, end_date date, start_portion string, end_portion string, working_days array<int>")
    assert {r.request_id: r.requested_days for r in V.request_days(f).collect()} == {1: 1.0, 2: 0.5, 3: 4.0, 4: 0.0, 5: 0.0}
    assert [r.reason for r in V.working_days(f.filter("request_id = 1")).orderBy("date").collect()] == ["WEEKEND", "WEEKEND", "PUBLIC_HOLIDAY", "PUBLIC_HOLIDAY", "WORKING"]


def test_apply_is_idempotent_and_ordered(spark):
    d = dt.date
    rows = [(1, 9, "ANNUAL", 1, "k", d(2024, 1, 1), d(2024, 1, 3), 3.0, True), (2, 9, "ANNUAL", 2, "k", d(2024, 1, 1), d(2024, 1, 3), 3.0, True), (3, 9, "ANNUAL", 3, "m", d(2024, 1, 3), d(2024, 1, 4), 1.0, True), (4, 9, "ANNUAL", 4, "n", d(2024, 2, 1), d(2024, 2, 2), 2.0, False), (5, 9, "ANNUAL", 5, "o", d(2024, 3, 1), d(2024, 3, 1), 1.0, True)]
    c = spark.createDataFrame(rows, "request_id long, employee_id long, leave_type string, seq long, idempotency_key string, start_date date, end_date date, requested_days double, needs_approval boolean")
    have = spark.createDataFrame([(9, "ANNUAL", 5.0)], "employee_id long, leave_type string, available double")
    got = {r.request_id: (r.result_id, r.status) for r in V.apply_requests(c, have).collect()}
    assert got == {1: (1, "PENDING_APPROVAL"), 2: (1, "PENDING_APPROVAL"), 3: (3, "REJECTED"), 4: (4, "APPROVED"), 5: (5, "REJECTED")}


def test_applied_requests_equal_a_scan_of_all_accepted(spark):
    import datetime
    import random

    rng, day = random.Random(3), datetime.date(2024, 1, 1)
    rows = []
    for k in range(300):
        start = day + datetime.timedelta(rng.randrange(200))
        rows.append((k, k % 3, rng.choice("AB"), k, f"k{rng.randrange(280)}", start, start + datetime.timedelta(rng.randrange(-1, 6)), float(rng.randrange(4)), rng.random() < 0.5))
    c = spark.createDataFrame(rows, "request_id long, employee_id long, leave_type string, seq long, idempotency_key string, start_date date, end_date date, requested_days double, needs_approval boolean")
    have = spark.createDataFrame([(0, "A", 60.0), (0, "B", 5.0), (1, "A", 100.0)], "employee_id long, leave_type string, available double")
    left, taken, first, want = {(0, "A"): 60.0, (0, "B"): 5.0, (1, "A"): 100.0}, [], {}, {}
    for k, who, kind, _, key, start, end, days, asks in rows:
        one = first.setdefault((who, key), k)
        if one == k:
            bad = end < start or any(w == who and start <= e and s <= end for w, s, e in taken) or days > left.get((who, kind), 0.0)
            if not bad:
                left[who, kind] = left.get((who, kind), 0.0) - days
                taken.append((who, start, end))
            want[k] = (k, "REJECTED" if bad else "PENDING_APPROVAL" if asks else "APPROVED")
        else:
            want[k] = (one, want[one][1])
    assert {r.request_id: (r.result_id, r.status) for r in V.apply_requests(c.repartition(4), have).collect()} == want
    assert len({s for _, s in want.values()}) == 3


def test_many_employees_cost_no_python_call_each(spark):
    d = dt.date
    kind = "request_id long, employee_id long, leave_type string, seq long, idempotency_key string, start_date date, end_date date, requested_days double, needs_approval boolean"
    # three requests an employee: the second meets the first, the third repeats the first
    rows = [(3 * e + k, e if e else None, "A", 3 * e + k, "kmk"[k], d(2024, 1, 1 + k % 2), d(2024, 1, 3), 1.0, e % 2 == 0) for e in range(40) for k in range(3)]
    have = spark.createDataFrame([(e, "A", 5.0) for e in range(1, 39)], "employee_id long, leave_type string, available double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # employees go on in the next batch
    try:
        df = V.apply_requests(spark.createDataFrame(rows, kind).repartition(3), have)
        got = {r.request_id: (r.employee_id, r.result_id, r.status) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for e in range(40):
        status = "REJECTED" if e in (0, 39) else "PENDING_APPROVAL" if e % 2 == 0 else "APPROVED"
        assert [got[3 * e + k] for k in range(3)] == [(e or None, 3 * e, status), (e or None, 3 * e + 1, "REJECTED"), (e or None, 3 * e, status)]
    plan = df._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_every_line_is_reconstructed(spark, tmp_path):
    from revlake import plans

    text = "\n".join(" ".join(f"w{i}_{j}" for j in range(20 + i)) for i in range(12))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = plans.QUERIES["p5_reconstruct_all_lines"](spark, str(tmp_path)).orderBy("line").collect()
    assert [r.text for r in got] == text.split("\n")


def test_approximate_search_finds_what_it_was_tuned_to(spark, monkeypatch):
    from revlake.plans import QUERIES
    from revlake.plans import retrieval as P

    monkeypatch.setattr(VI, "BLOCK_ROWS", 20)  # a list in several blocks
    sf = "/root/testdata/sf0.1"
    exact = {(r.query_id, r.id): r.score for r in R.vector_topk(P.vector_queries(spark, sf), P.vectors(spark, sf), 10).collect()}
    got = {(r.query_id, r.id): r.score for r in QUERIES["r1b_vector_topk_approx"](spark, sf).collect()}
    shared = got.keys() & exact.keys()
    print("recall", len(shared) / len(exact))
    assert len(shared) >= 0.95 * len(exact)
    assert all(abs(got[x] - exact[x]) < 1e-8 for x in shared)


def test_lists_grow_with_the_rows_and_take_new_ones(spark, tmp_path):
    """Real vectors have neighbourhoods: the larger the table, the smaller the share of codes that a query reads."""
    import numpy as np

    rng = np.random.default_rng(1)
    middles = rng.standard_normal((60, 24))
    make = lambda n: middles[rng.integers(0, 60, n)] + 0.35 * rng.standard_normal((n, 24))
    frame = lambda m, start=0: spark.createDataFrame([(start + i, x.tolist()) for i, x in enumerate(m)], "id long, vector array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(make(50))], "query_id long, vector array<double>")
    shares = []
    for n in (500, 5000):
        m = make(n)
        index = VI.build_lists(frame(m), str(tmp_path / str(n)), subspaces=8)
        VI.tune(asked, index, 5)
        got = VI.vector_topk_approx(asked, index, 5, counts=True)
        exact = {(r.query_id, r.id) for r in R.vector_topk(asked, frame(m), 5).collect()}
        assert len({(r.query_id, r.id) for r in got.collect()} & exact) >= 0.95 * len(exact)
        shares.append(got.select((F.col("codes_read") / F.col("codes")).alias("s")).agg(F.avg("s")).first()[0])
    assert shares[1] < 0.7 * shares[0]
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "5000").rglob("*.parquet")}
    VI.add_rows(index, asked.withColumnRenamed("query_id", "id").withColumn("id", F.col("id") + 100_000))
    first = VI.vector_topk_approx(asked, index, 5).filter("rank = 1").collect()
    assert len(first) == 50 and all(r.id == r.query_id + 100_000 and r.score == 1.0 for r in first)
    assert all(f.stat().st_mtime_ns == t for f, t in files.items())  # nothing stored before was written again


def test_cosine_of_unequal_widths_is_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="unequal width"):
        df.select(R.cosine(F.col("a"), F.col("b"))).collect()
    none = spark.createDataFrame([(None, [1.0])], "a array<double>, b array<double>")
    assert none.select(R.cosine(F.col("a"), F.col("b"))).first()[0] is None


def test_stored_trigrams_find_what_a_scan_finds(spark, tmp_path, capsys):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abcAB_%-é9 ") for _ in range(rng.randrange(0, 14)))
    rows = [(k, name(), None if k % 7 == 0 else name()) for k in range(800)] + [(900, "The Travel Policy", None), (901, None, "travel_policy 50%")]
    df = spark.createDataFrame(rows, "document_id long, document_code string, title string")
    index = NI.store_names(df, str(tmp_path), "document_id", ("document_code", "title"))
    for needle in ["travel", "vel_pol", "TRAV%y", "abc", "ab", "", "%", "bc_a", "cab%ab", "50\\%", "l\\_p", "zzz", "é9a"]:
        want = sorted(r.document_id for r in L.search_documents(df, needle).collect())
        assert sorted(r.document_id for r in NI.search_names(index, needle).collect()) == want, needle
    few = NI.search_names(index, "travel")
    few.explain("formatted")
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", capsys.readouterr().out)
    assert NI.candidates(index, "travel").count() == 2


def test_overlaps_of_an_employee_with_very_many_requests(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    start = np.sort(rng.integers(0, 30_000, 60_000))
    end = start + rng.integers(0, 3, len(start))
    hot = [(1, k, int(a), int(b)) for k, (a, b) in enumerate(zip(start.tolist(), end.tolist()))]
    odd = [(2, 100_000, 10, 400), (2, 100_001, 200, 210), (2, 100_002, 400, 500), (2, 100_003, 205, 203), (2, 100_004, 20, 5), (2, 100_005, 401, None), (3, 100_006, 10, 400)]
    df = spark.createDataFrame(hot + odd, "employee_id long, request_id long, s int, e int").select("employee_id", "request_id", F.date_from_unix_date("s").alias("start_date"), F.date_from_unix_date("e").alias("end_date"))
    got = V.overlaps(df, df)
    few = sorted(map(tuple, got.filter("request_id >= 100000").collect()))
    want = sorted((a[1], b[1]) for a in odd for b in odd if a[0] == b[0] and a[1] != b[1] and None not in (*a, *b) and a[2] <= b[3] and b[2] <= a[3])
    assert few == want
    pairs = int((np.searchsorted(start, end, side="right") - np.arange(len(start)) - 1).sum()) * 2
    assert got.filter("request_id < 100000").count() == pairs == got.filter("request_id < 100000").distinct().count()


def test_sketches_keep_their_error_over_any_range(spark, tmp_path):
    rng = random.Random(1)
    values = lambda: rng.choice([0.0, 1e-12, -rng.lognormvariate(0, 3), rng.lognormvariate(2, 2), float(rng.randrange(5))])
    rows = [(f"2024-01-{1 + k % 20:02d} 10:00:00", values()) for k in range(6000)]
    odd = [("2024-01-03 00:00:00", v) for v in (None, float("nan"), float("inf"), float("-inf"))]
    df = spark.createDataFrame(rows + odd, "t string, v double").withColumn("ts", F.to_timestamp("t"))
    path = str(tmp_path)
    SK.store(df, path, "v", "ts")
    SK.store(df.filter("day(ts) = 4"), path, "v", "ts")  # comes again
    for first, last in (("2024-01-01", "2024-01-20"), ("2024-01-04", "2024-01-04"), ("2024-01-15", "2024-02-15")):
        own = sorted(v for t, v in rows if first <= t[:10] <= last)
        got = SK.read_quantiles(spark, path, first, last).first()
        assert got.n == len(own) and got["mean"] == pytest.approx(sum(own) / len(own))
        for p in (50, 95, 99):
            exact = own[-(-p * len(own) // 100) - 1]
            assert abs(got[f"p{p}"] - exact) <= SK.ERROR * abs(exact) * (1 + 1e-9) + SK.LEAST, (first, p)
    assert SK.read_quantiles(spark, path, "2025-01-01", "2025-01-02").first().n is None


@pytest.mark.parametrize("descending", [False, True])
def test_a_page_far_down_reads_one_block(spark, tmp_path, capsys, descending):
    rng = random.Random(2)
    rows = [(k, None if k % 50 == 0 else rng.randrange(30), "x") for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, v int, name string").repartition(7)
    pages = P.store_pages(df, str(tmp_path), ("v", "id"), descending, block_rows=100)
    want = sorted(((r[1] is not None, r[1] or 0, r[0]) for r in rows), reverse=descending)
    ids = [w[2] for w in want]
    for number, size in ((1, 10), (125, 24), (7, 100), (11, 70), (400, 10)):
        assert [r.id for r in P.page(pages, number, size).collect()] == ids[(number - 1) * size : number * size]
    P.page(pages, 125, 24).explain("formatted")
    assert re.search(r"PartitionFilters: \[[^\]]*block#\d+L? IN \(29\)|PartitionFilters: \[[^\]]*block#\d+L? = 29", capsys.readouterr().out)
    for at in (0, 98, 99, 1500, 2990, 2999):
        key = (rows[ids[at]][1], ids[at])
        assert [r.id for r in P.after(pages, key, 25).collect()] == ids[at + 1 : at + 26], at
    assert [r.id for r in P.after(pages, (7, -1), 5).collect()] == ([i for k, v, i in want if k and v < 7] if descending else [i for k, v, i in want if k and v >= 7])[:5]


def test_index_of_many_parts(spark, sf, tmp_path, monkeypatch):
    # a bucket of an index of many slots is written by a task for each part of them, and holds what one task would write
    from revlake.sources import adapters as A

    chunks = A.chunks(spark, sf).filter("revision_id < 9")
    rows = lambda i: sorted((r.term, r.chunk_id, round(r.weight, 9), r.tf, tuple(r.positions)) for r in i.postings.collect())
    want = rows(X.store_index(chunks, f"{tmp_path}/one"))
    for name, value in (("SLOT_CHUNKS", 20), ("PART_SLOTS", 2), ("BUCKETS", 3), ("GATHERED", 50)):
        monkeypatch.setattr(X, name, value)
    index = X.store_index(chunks, f"{tmp_path}/many")
    files = index.blocks().select("bucket", F.input_file_name().alias("file")).groupBy("bucket").agg(F.countDistinct("file").alias("n")).agg(F.max("n")).first()[0]
    assert rows(index) == want and files > 1
    assert index.blocks().groupBy("term", "slot").count().filter("count > 1").count() == 0
    X.replace_revisions(index, chunks.select("revision_id").filter("revision_id % 3 = 0").distinct(), chunks.filter("revision_id % 3 = 0 and chunk_index < 2"))
    X.merge_segments(index, list(index.segments()))
    assert rows(index) == [r for r in want if r[1] // A.CHUNKS % 3 or r[1] % A.CHUNKS < 2]


def test_vector_topk_keeps_its_best_of_a_partition(spark, monkeypatch):
    # many steps of one partition and many equal scores: each query keeps k rows of it, those of the least ids among equals
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (700, 4)).astype(float)
    monkeypatch.setattr(R, "STEP_ROWS", 32)
    rows = spark.createDataFrame([(i, x.tolist(), str(i % 2)) for i, x in enumerate(v)], "id long, vector array<double>, kind string").coalesce(1)
    asked = spark.createDataFrame([(q, v[q].tolist(), str(q % 2)) for q in range(0, 60, 7)], "query_id long, vector array<double>, kind string")
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    score = np.round(unit @ unit.T, 9)
    for same in (None, "kind"):
        want = {(q, n, i) for q in range(0, 60, 7) for n, i in enumerate(sorted((i for i in range(700) if not same or i % 2 == q % 2), key=lambda i: (-score[q, i], i))[:6], 1)}
        assert {(r.query_id, r["rank"], r.id) for r in R.vector_topk(asked, rows, 6, same=same).collect()} == want
    kept = R.best_of_steps(iter([rows.toPandas().assign(g="")]), v[:9], np.arange(9), np.array([""] * 9, object), 6)
    assert len(kept) == 54


def test_a_scan_finds_what_the_index_finds(spark, tmp_path, monkeypatch):
    """F3 to F23: a batch of questions is searched without an index; nothing but each task's best is shuffled."""
    rng = random.Random(11)
    said = lambda n: " ".join(rng.choice(["red", "Green", "blues", "walking", "a-b", "İx", "zz", ""]) for _ in range(n))
    rows = [(k, f"c-{k % 3}", said(2), None if k % 4 else said(2), said(12)) for k in rng.sample(range(10_000), 400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_code string, section_title string, subsection_title string, content string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(["red green", "zz -red", '"red green" or blues', "none red", "a b c", "x", ""])), "query_id long, query string")
    monkeypatch.setattr(X, "GATHERED", 500)
    monkeypatch.setattr(X, "MOST_SCANNED", 3)
    for more, rank in (((), "weights"), ((), "cover"), ((("a",), True), "weights")):
        index = X.store_index(chunks, str(tmp_path / f"{rank}{len(more)}"), *more)
        want = {(r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in X.lexical_topk(asked, index, 7, rank).collect()}
        got = {(r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in X.scan_topk(asked, chunks, 7, rank, *more).collect()}
        assert got == want and len({q for q, *_ in got}) >= 4


def test_fused_lists_shuffle_no_chunks(spark, sf):
    """F3 to F23, F30: neither texts, vectors nor postings are shuffled for the fused list, only what a task found best."""
    from revlake.plans import retrieval as P

    known = dict(P._STORED)
    P._STORED.clear()
    try:
        assert shuffled(spark, lambda: P.fused_hits(spark, sf).count()) < 3_000_000
        assert not any(key[2] in ("index", "vectors") for key in P._STORED)
    finally:
        P._STORED.clear()
        P._STORED.update(known)


def test_chunker_holds_few_documents_at_once(spark, tmp_path):
    """F32: the documents of an Arrow batch become Python objects some at a time, not all before the first is chunked."""
    rows = spark.range(400).select((F.col("id") % 200).alias("revision_id"), F.col("id").alias("position"), *[F.lit(None).cast("string").alias(c) for c in ("section", "subsection")], F.lit("CONTENT").alias("role"), F.lit("paragraph").alias("kind"), F.lit("text").alias("text"), F.lit(1).alias("page")).coalesce(1)

    def count(blocks, cfg):
        import gc

        alive = sum(1 for o in gc.get_objects() if isinstance(o, dict) and "position" in o and "subsection" in o)
        return [{"chunk_type": "CHILD", "content": blocks[0]["text"], "tokens": alive}]

    got = S.chunk(rows, chunker=count).collect()
    assert len(got) == 200 and all(r.content == "text" and r.page_start is None for r in got)
    assert max(r.tokens for r in got) <= 2 * 64 * 2


def test_texts_of_many_questions_are_not_shuffled(spark, monkeypatch):
    """F10 to F13, F20 to F22: beyond MOST_QUERIES questions texts are read again where they lie, not dealt to tiles."""
    rng = random.Random(5)
    said = lambda n: " ".join(rng.choice(["red", "green", "blue", "walk", "run"]) + str(rng.randint(0, 9)) for _ in range(n))
    texts = spark.createDataFrame([(k, said(400)) for k in range(200)], "id long, vector string").repartition(3).localCheckpoint()
    asked = J.hash_embed(spark.createDataFrame([(k, said(3)) for k in range(30)], "query_id long, content string"), out="vector").select("query_id", "vector").localCheckpoint()
    found = lambda: {(r.query_id, r["rank"], r.id, r.score) for r in R.vector_topk(asked, texts, 4, embed=J.hash_vectors).collect()}
    want = found()
    monkeypatch.setattr(R, "MOST_QUERIES", 7)
    monkeypatch.setattr(R, "MOST_EMBEDDED", 7, raising=False)
    got = []
    assert shuffled(spark, lambda: got.append(found())) < 100_000
    assert got == [want] and len(want) == 120


def test_words_of_a_column():
    """F10 to F13, F20 to F22: words and vectors of a batch are those of text after text, with no vocabulary that a worker has to keep."""
    import numpy as np
    import pyarrow as pa

    from revlake.functions.words import words_of

    rng = random.Random(3)
    bits = ["a", "B", "é", "İ", "K", " ", "-", "9", "zq" * 3, "wordofmore", "x" * 150, "\U0001f600", "\n", "and the "]
    for n in range(60):
        texts = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(n % 7)]
        own, got = words_of(pa.array(["qq", *texts], pa.string()).slice(1)), [[] for _ in texts]
        for row, number in zip(own.row, own.number):
            got[row].append(own.spelled()[number].decode())
        assert got == [re.findall("[a-z0-9]+", t.lower()) for t in texts] and len(set(own.spelled())) == len(own.size)
        want = np.zeros((len(texts), 64))
        for row, words in enumerate(got):
            for word, tf in Counter(words).items():
                for at, sign in zip(*J.slots(word, 64, 4)):
                    want[row, at] += sign * (1 + np.log(tf))
            want[row, 0] += not want[row].any()
        assert np.allclose(J.hash_vectors(texts), want / np.maximum(np.linalg.norm(want, axis=1), 1e-300)[:, None], atol=1e-12)
    assert not hasattr(J, "Vocabulary")
