import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from llm.conftest import lower_ascii
from ledgerlens.llm import merkle
from ledgerlens.llm.merkle import document_manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    fields = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        low = i - i % 8
        out.append((level[low:i], level[i + 1:low + 8]))
        i //= 8
    return out


def brute_force(rows, tampered):
    """``(doc, leaf, subroot, root, proof, number of copies, folded root)`` of every row, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf_of(r, r["text"]), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, bytes.fromhex(x[1])))
        trees[name] = tree([x[1] for x in groups[name]])
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for g, name in enumerate(names):
        for i, (doc, leaf, r) in enumerate(groups[name]):
            steps = way(trees[name], i) + way(top, g)
            changed = tampered(doc)
            node = leaf_of(r, r["text"] and lower_ascii(r["text"])) if changed else leaf
            for left, right in steps:
                node = h("".join([*left, node, *right]))
            proof = h("".join("".join(left + right) for left, right in steps))
            out.append((doc, leaf, trees[name][-1][0], top[-1][0], proof, len(steps) if changed else None, node))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in rows)
    assert all(r["copies"] is None or not r["copies"] or r["copies"][-1] == r["folded_root"] for r in rows)
    return sorted(((r["doc"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"],
                    None if r["copies"] is None else len(r["copies"]), r["folded_root"]) for r in rows), key=str)


def check(docs):
    def hit(doc):
        return doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
    got = found(document_manifest(docs, F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0))
    assert got == brute_force(docs.collect(), hit)
    return got


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("count", [0, 1, 2, 8, 9, 64, 65, 100])
def test_sizes_of_runs(spark, count):
    """A lone leaf, whole runs, last runs of one; one group and as many groups as rows."""
    rows = [(i * 7, "s", "en", 3, f"Text {i}") for i in range(count)]
    own = [(*r[:2], f"l{r[0]}", *r[3:]) for r in rows]
    for some in (rows, own):
        check(spark.createDataFrame(some, SCHEMA))


def test_blocks_and_upper_levels(spark, monkeypatch):
    """Blocks of eight leaves, so that most levels lie above the blocks; one
    group holds most rows, others one block or one leaf."""
    monkeypatch.setattr(merkle, "DEPTH", 1)
    rows = [(i, "s", "en" if i % 10 else f"g{i % 300}", i, f"Text {i}" if i % 4 else None) for i in range(1200)]
    rows += [(-5, "s", None, 0, "A"), (3000, None, "solo", None, "B")]
    got = check(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert {len(x) for x in got} == {7} and max(x[5] or 0 for x in got) >= 5


def test_tables(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_and_empty(odd, empty):
    check(odd.withColumn("n_chars", F.length("text")).withColumn("grp", F.lit("x")).withColumn("pos", F.lit(1))
          .withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).when(F.col("doc_id") > 8, "").otherwise("en")))
    none = empty.withColumn("n_chars", F.length("text"))
    assert document_manifest(none, F.lit(True)).count() == 0


def test_versions_share_untouched_nodes(spark):
    """A version's copies are the leaf's ancestors alone, and verify against its root."""
    levels = merkle.block_levels([h(str(i)) for i in range(20)], 2)
    steps = merkle.siblings(levels, 17)
    copies = merkle.path_copy(h("x"), steps)
    changed = [h("x") if i == 17 else h(str(i)) for i in range(20)]
    assert [level[17 // 8 ** (i + 1)] for i, level in enumerate(merkle.block_levels(changed, 2)[1:])] == copies
    assert merkle.block_levels([h(str(i)) for i in range(20)], 2) == levels
