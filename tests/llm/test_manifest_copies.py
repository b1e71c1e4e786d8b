"""Merkle manifest and exact copies against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from gradewise.llm import chunks, merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def level_up(nodes):
    return [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def path_of(nodes, at):
    """[(sibling is left, hash)] of the levels below the root, and the root."""
    steps = []
    while len(nodes) > 1:
        other = at ^ 1
        steps.append((other < at, nodes[other]) if other < len(nodes) else None)
        nodes, at = level_up(nodes), at >> 1
    return steps, nodes[0]


def brute_proofs(rows):
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        then = leaf(doc_id, source, lang, None if n_chars is None else n_chars + 1, text) if hit else own
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, then, doc_id))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {g: [x[2] for x in sorted(trees[g])] for g in order}
    roots = [path_of(leaves[g], 0)[1] for g in order]
    out = []
    for place, g in enumerate(order):
        above, root = path_of(roots, place)
        for at, (_, _, own, then, doc_id) in enumerate(sorted(trees[g])):
            steps = path_of(leaves[g], at)[0] + above
            for step in steps:
                then = h(then) if step is None else h(step[1], then) if step[0] else h(then, step[1])
            out.append((doc_id, own, roots[place], root, h(*[s[1] for s in steps if s]), then, then == root))
    return sorted(out, key=str)


def proof_rows(docs):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.tamper_report(docs).select(names).collect()), key=str)


def test_proofs_of_given_and_odd_rows(spark, given, odd, none):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (given, odd):
        rows = [tuple(r) for r in docs.select(names).collect()]
        assert proof_rows(docs) == brute_proofs(rows)
    assert merkle.tamper_report(none).count() == 0
    alone = odd.where("doc_id = 7")
    assert proof_rows(alone) == brute_proofs([tuple(r) for r in alone.select(names).collect()])


@pytest.mark.parametrize("sizes", [(256, 257, 1), (513, 2, 3, 300)])
def test_proofs_of_trees_of_several_stages(spark, sizes):
    rows, i = [], 0
    for g, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i * 7919 % 100_003, f"text {i}", None if g == 2 else f"l{g}", "s", i))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = proof_rows(docs)
    assert got == brute_proofs(rows)
    assert 0 < sum(not r[-1] for r in got) < len(rows) / 3
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_many_trees(spark):
    rows = [(i, "t", f"lang {i % 300}", "s", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert proof_rows(docs) == brute_proofs(rows)


def brute_copies(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        best = max(ids, key=lambda x: (x is not None, x or 0))
        stays = True
        for x in ids:
            out.append((x, best, len(ids), x == best and stays, hashlib.sha256(text.encode()).hexdigest()))
            stays &= x != best
    return sorted(out, key=str)


def copy_rows(docs, **how):
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in chunks.exact_duplicates(docs, **how).select(names).collect()), key=str)


def test_copies_of_given_and_odd_rows(spark, given, odd, none):
    for docs in (given, odd):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert copy_rows(docs) == brute_copies(rows)
        assert sum(r[3] for r in copy_rows(docs)) == len({t or "" for _, t in rows})
    assert chunks.exact_duplicates(none).count() == 0


def test_digests_that_clash_are_taken_anew(spark, given):
    rows = [tuple(r) for r in given.select("doc_id", "text").collect()]
    assert not chunks.shared_digests(chunks.distinct_chunks(given, 1)).isEmpty()
    assert copy_rows(given, size=1) == brute_copies(rows)


def test_texts_that_differ_in_one_place(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(60_000))
    texts = [base, base[:-1], "x" + base, base[:30_000] + "!" + base[30_000:], base, base + "\x00", base * 2, "é" + base]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert copy_rows(docs) == brute_copies(list(enumerate(texts)))
    whole = sum(len(t.encode()) for t in texts)
    moved = sum(len(r.chunk) for r in chunks.distinct_chunks(docs).collect())
    assert moved < whole / 5  # what the texts share moves once


def test_cuts_depend_on_the_text_alone(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 200_000, dtype=np.uint8)
    whole = chunks.cut_places(data)
    monkeypatch.setattr(chunks, "BLOCK", 1000)
    assert whole.tolist() == chunks.cut_places(data).tolist()
    later = chunks.cut_places(data[777:]) + 777
    assert later[later > 777 + chunks.WINDOW].tolist() == whole[whole > 777 + chunks.WINDOW].tolist()
    ends = chunks.cut_ends(len(data), whole.tolist())
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= chunks.MOST and (sizes[:-1] >= chunks.LEAST).all()
    assert chunks.cut_ends(0, []) == [] and chunks.cut_ends(5, []) == [5]
    assert chunks.cut_ends(40_000, []) == [16384, 32768, 40_000]
