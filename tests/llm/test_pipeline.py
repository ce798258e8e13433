"""The whole pipeline against a plain version on the smallest tables, and each stage on awkward rows."""

import re
from collections import Counter

import corpus_pipeline as P
from tests.conftest import SMALL
from tests.llm.helpers import UNSPACED
from tests.llm.test_decontaminate import plain as plain_matches
from tests.llm.test_mixing import plain_mix
from tests.llm.test_near_dup import plain as plain_components


def plain_run(docs, bench):
    """Words that the mix takes of every document that the first three stages keep."""
    docs = [d for d in docs if re.search(r"[^\W\d_]", d["text"] or "")]
    comp = plain_components([(d["doc_id"], d["text"]) for d in docs])
    docs = [d for d in docs if comp[d["doc_id"]][1] == d["doc_id"]]
    hits = plain_matches([d["text"] for d in docs], bench, 10)
    docs = [d for d, (_, n, _) in zip(docs, hits, strict=True) if n == 0]
    mixed = plain_mix([(d["doc_id"], d["text"], d["source"]) for d in docs])
    return {k: n * len(at) for k, _, n, *_, at in mixed if at}


def test_run_agrees_with_the_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = P.run(spark, SMALL).collect()
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += len(UNSPACED.findall(r["text"]))
    assert dict(got) == plain_run(docs, bench)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += len(r["text"].encode()) + 1
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= max(len(r["text"].encode()) + 1 for r in rows)


def test_stages_keep_the_columns_and_survive_awkward_rows(spark):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(1, "plain words here", "en", "a", 1), (1, "plain words here", "en", "a", 1), (2, None, None, None, None), (3, "", "de", "", 0), (None, "no id at all", "en", None, 5), (4, long, None, "a", 7)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, SMALL)
            if k < len(P.STAGES) - 1:
                assert out.columns == docs.columns
            else:
                assert set(docs.columns) < set(out.columns)
            assert out.count() <= 3 * len(data)


def test_stage_names_and_registration():
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "mix", "shards"]
    assert set(P.queries()) == {"pipeline"} and P.oracle_sql() == {}
