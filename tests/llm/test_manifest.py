import hashlib
import zlib

import pytest
from conftest_llm import ROWS, SCHEMA, rows

from wheelbase.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, index, start):
    """(siblings level by level, what the path folds to, the tree's own root) by building every level as a list."""
    proof, folded = [], start
    while len(nodes) > 1:
        run = [i for i in range(len(nodes)) if i // 3 == index // 3]
        proof += [nodes[i] for i in run if i != index]
        folded = h(*(folded if i == index else nodes[i] for i in run))
        nodes = [h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
        index //= 3
    return proof, folded, nodes[0]


def brute(table):
    by_source = {}
    for r in table:
        by_source.setdefault(r[3], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    leaves = {s: [leaf(*r) for r in by_source[s]] for s in order}
    subroots = [climb(leaves[s], 0, "")[2] for s in order]
    out = []
    for at, s in enumerate(order):
        for i, r in enumerate(by_source[s]):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            proof, folded, subroot = climb(leaves[s], i, leaf(r[0], text, *r[2:]))
            more, folded, root = climb(subroots, at, folded)
            out.append((r[0], leaves[s][i], subroot, root, h(*proof, *more), folded, folded == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_manifest_equals_trees_built_level_by_level(spark, depth):
    table = [*ROWS, ROWS[0], *[(i, f"row {i}\n", "en", "hot", i) for i in range(100, 168)], *[(i, "x\ny", None, f"s{i}é", None) for i in range(200, 229)]]
    got = rows(merkle.manifest(spark.createDataFrame(table, SCHEMA), depth), *COLUMNS)
    assert got == brute(table)
    assert {r[-1] for r in got} == {True, False}


def test_one_row_one_source_and_no_rows(spark, empty):
    for table in (ROWS[:1], [(i, "a\nb", "en", "only", 1) for i in range(1, 8)], [(None, None, None, None, None)]):
        assert rows(merkle.manifest(spark.createDataFrame(table, SCHEMA), 1), *COLUMNS) == brute(table)
    assert rows(merkle.manifest(empty)) == []


def test_extra_columns_do_not_matter(docs, clashing):
    more = clashing.selectExpr("*", "1 AS tree", "2 AS idx", "3 AS part", "4 AS leaf", "5 AS shown", "6 AS n_part", "7 AS `first`")
    assert rows(merkle.manifest(more)) == rows(merkle.manifest(docs))


@pytest.mark.parametrize("first,count,n", [(0, 1, 1), (0, 9, 9), (4, 3, 20), (0, 27, 28), (18, 9, 83), (82, 1, 83)])
def test_octopus_is_the_fewest_nodes_that_give_the_root(first, count, n):
    leaves = [h(str(i)) for i in range(n)]
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(merkle.parents(levels[-1]))
    asked = merkle.coordinates(first, count, n)
    known = {(0, i): leaves[i] for i in range(first, first + count)} | {(k, i): levels[k][i] for k, i in asked}
    steps = list(merkle._paths(known, first, first + count - 1, n))
    assert known[len(steps), 0] == levels[-1][0]

    def derivable(held):
        held = set(held)
        for k in range(len(levels) - 1):
            for parent in range(len(levels[k + 1])):
                if all((k, i) in held for i in range(parent * 3, min(parent * 3 + 3, len(levels[k])))):
                    held.add((k + 1, parent))
        return held

    own = {(0, i) for i in range(first, first + count)}
    for left_out in asked:
        rest = own | {c for c in asked if c != left_out}
        assert left_out not in derivable(rest), "a node that could be derived was fetched"
