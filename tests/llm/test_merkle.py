"""The Merkle manifest against a tree by hand and its SQL."""

import hashlib
import zlib

import duckdb
import pytest

from starweave.llm import merkle
from starweave.llm.oracles import OP13

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def _tree(digests):
    """(root, proofs): a proof is a list of (place, siblings)."""
    proofs, below = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [range(i, min(i + 3, len(digests))) for i in range(0, len(digests), 3)]
        for run in runs:
            for i in run:
                for leaf in below[i]:
                    proofs[leaf].append((i - run[0], [digests[j] for j in run if j != i]))
        digests, below = [sha(*(digests[i] for i in run)) for run in runs], [sum((below[i] for i in run), []) for run in runs]
    return digests[0], proofs


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, _leaf(r, r[4]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    root, tops = _tree([trees[s][0] for s in order]) if order else ("", [])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, _, leaf, r), proof in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            cut = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = _leaf(r, r[4].replace("\n", "")) if cut else leaf
            for place, siblings in proof + top:
                folded = sha(*siblings[:place], folded, *siblings[place:])
            out.append((r[0], leaf, trees[s][0], root, sha(*(x for _, run in proof + top for x in run)), folded, folded == root))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, merkle.verify(merkle.manifest(df)).collect()), key=str)


EDGE = [
    *((i, None if i % 7 == 0 else "hot" if i % 2 else f"s{i % 5}", None, i, f"a\nb{i}" if i % 3 else None) for i in range(1200)),
    *[(5, "hot", None, 5, "a\nb5")] * 4, (5, "hot", "x", None, ""), (None, "z", None, None, None), (2000, "é", "en", 3, "漢字\n\r\n"), (2001, "Z", "en", 3, "x" * 300000 + "\n"),
]


def test_manifest_is_brute_force(spark):
    df = spark.createDataFrame(EDGE, SCHEMA).repartition(7)
    assert result(df) == brute(EDGE)
    # columns of clashing names do not matter, nor does the number of partitions
    extra = df.selectExpr("*", "'x' AS digest", "1 AS pos", "2 AS grp", "'y' AS leaf", "0 AS uid").repartition(2)
    assert result(extra) == brute(EDGE)
    for n in (0, 1, 2, 4, 10):
        assert result(spark.createDataFrame(EDGE[:n], SCHEMA)) == brute(EDGE[:n])
    assert result(spark.createDataFrame([(i, "one", None, None, "") for i in range(28)], SCHEMA)) == brute([(i, "one", None, None, "") for i in range(28)])


def test_many_sources_and_sweeps(spark):
    rows = [(i, f"s{i % 40:03d}", "en", 1, f"{i}\n") for i in range(700)]
    # a source of over 243 rows needs a second sweep
    rows += [(i, "s000", "en", 1, f"{i}") for i in range(1000, 1400)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_manifest_is_its_sql(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    assert result(df) == sorted(con.execute(OP13).fetchall(), key=str) == brute([tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 26, 27, 28, 100, 243])
def test_sweeps_of_one_block(n):
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    tree = merkle.forward(digests, merkle.height(n))
    root, proofs = _tree([d.hex() for d in digests])
    assert tree[-1][0].hex() == root
    got = merkle.backward(tree, b"\x00")  # a level without siblings above
    for d, mine, want in zip(digests, got, proofs, strict=True):
        steps = list(merkle.steps(mine))
        assert steps[-1] == (0, []) and [(p, [s.hex() for s in run]) for p, run in steps[:-1]] == want
        assert merkle.fold(d, mine[:-1]).hex() == root
        if n > 1:
            assert merkle.fold(hashlib.sha256(d).digest(), mine[:-1]).hex() != root


def test_without_tampering_all_verify(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = merkle.verify(merkle.manifest(df, tamper=None)).collect()
    assert len(rows) == df.count() and all(r.verified and r.folded_root == r.root for r in rows)
