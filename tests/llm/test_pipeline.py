import os
import subprocess
import sys
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from llm.conftest import ODD_TEXTS
from llm.test_decontaminate import brute as brute_hits
from llm.test_jaccard_join import brute_components
from llm.test_mixing import targets

ROOT = os.path.dirname(os.path.abspath(pipeline.__file__))


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows of the input and of every stage's result on the smallest tables."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"input": docs.collect()}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name in ("language_id", "near_duplicates", "decontamination", "mixing"):
        assert stages[name][0].asDict().keys() == stages["input"][0].asDict().keys()


def test_language_keeps_texts_with_letters(stages):
    want = {r["doc_id"] for r in stages["input"] if r["text"] and any(map(str.isalpha, r["text"]))}
    assert {r["doc_id"] for r in stages["language_id"]} == want


def test_one_of_each_group_stays(stages):
    groups = brute_components({r["doc_id"]: r["text"] for r in stages["language_id"]}, 5, 80)
    assert Counter(r["doc_id"] for r in stages["near_duplicates"]) == Counter(i for i, (_, c) in groups.items() if c == i)


def test_contaminated_documents_go(stages, spark, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    judged = brute_hits([(r["doc_id"], r["text"]) for r in stages["near_duplicates"]], items)
    want = {int(i) for i, n, hit, _ in judged if not (hit and 20 * hit >= n)}
    assert len(want) < len(judged)
    assert Counter(r["doc_id"] for r in stages["decontamination"]) == Counter(want)


def test_mix_meets_its_targets(stages):
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in stages["decontamination"]}
    sizes, took = defaultdict(int), defaultdict(int)
    for r in stages["decontamination"]:
        sizes[r["source"]] += size[r["doc_id"]]
    for r in stages["mixing"]:
        took[r["source"]] += size[r["doc_id"]]
    assert max(Counter(r["doc_id"] for r in stages["mixing"]).values()) <= 2
    goal = targets(sizes)
    longest = max(size.values())
    assert all(abs(took[s] - goal[s]) <= longest for s in sizes)
    assert sum(abs(took[s] - goal[s]) for s in sizes) <= 0.02 * sum(goal.values())
    texts = {r["doc_id"]: tuple(r) for r in stages["decontamination"]}
    assert all(texts[r["doc_id"]] == tuple(r) for r in stages["mixing"])


def test_shards_are_even(stages):
    rows = stages["sharding"]
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in stages["mixing"])
    counts = Counter(r["shard"] for r in rows)
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1
    where = defaultdict(set)
    for r in rows:
        where[r["doc_id"]].add(r["shard"])
    # copies of a document stay together but where a full shard hands on
    assert sum(len(s) > 1 for s in where.values()) <= 16


def test_run_gives_the_last_stage(spark, sf, stages):
    again = pipeline.run(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, stages["sharding"]))


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_odd_and_empty_tables(spark, sf, odd, empty, name, stage):
    assert stage(spark, empty, sf).count() == 0
    rows = stage(spark, odd, sf).collect()
    if name == "sharding":
        assert len(rows) == len(ODD_TEXTS)
        return
    assert set(rows[0].asDict()) == set(odd.columns)
    got = Counter((r["doc_id"], r["text"]) for r in rows)
    given = Counter(ODD_TEXTS)
    if name in ("language_id", "decontamination"):
        assert all(got[k] in (0, given[k]) for k in given) and not got - given
    elif name == "near_duplicates":
        assert max(got.values()) == 1 and {1, 3, 4, 5, 6, 7, 10, 11} <= {i for i, _ in got}
        assert not {2, 8, 9, 12} & {i for i, _ in got} and (None, "one two three") not in got
    else:
        assert all(n <= 2 * given[k] for k, n in got.items())


def test_the_rest_works_without_this_package(tmp_path):
    """The entry module imports, and the other queries stay, when the package
    and the pipeline are gone."""
    for name in ("__spark_entry__.py", "bench.py"):
        (tmp_path / name).symlink_to(f"{ROOT}/{name}")
    (tmp_path / "ledgerlens").mkdir()
    for name in os.listdir(f"{ROOT}/ledgerlens"):
        if name not in ("llm", "__pycache__"):
            (tmp_path / "ledgerlens" / name).symlink_to(f"{ROOT}/ledgerlens/{name}")
    code = ("import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; "
            "q = e.queries(); assert 'aged_by_partner' in q and not [n for n in q if n.startswith('op')]; "
            "assert 'pipeline' not in q and set(e.oracle_sql()) <= set(q)")
    # run from a copy: the entry module puts its own (real) folder on the path
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], check=True, cwd=tmp_path, timeout=120)
