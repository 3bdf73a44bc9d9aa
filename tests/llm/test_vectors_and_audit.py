"""Vector codes, exact search and the filter audit against brute force, on awkward rows and on the smallest data set."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from knotmeter.llm import exact_search, filter_audit, queries, vector_codes, vectors
from knotmeter.session import materialize

SF = "/root/testdata/sf0.001"
DDL = "vec_id long, embedding array<float>, label int, row long, ints string, part int, q string, salt int"


def frame(spark, rows):
    """Rows of (vec_id, vector, label), with columns that the operators might use inside."""
    full = [(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, "x", 2, "y", 3) for i, v, label in rows]
    return materialize(spark.createDataFrame(full, DDL).repartition(5))


def awkward(seed, n=420, dims=8):
    """Random vectors with nulls, non-finite numbers, other lengths, ties, repeated rows and shared or missing ids."""
    rng = np.random.default_rng(seed)
    rows = [(i, np.round(rng.normal(size=dims), 2), int(rng.integers(0, 4)) if i % 7 else None) for i in range(n)]
    same = np.full(dims, 0.25)
    rows += [(1000 + i, same, 9) for i in range(n // 2)]
    rows += [rows[20], rows[20], rows[40], (40, rows[41][1], 1), (None, rows[3][1], None), (None, same, 9)]
    rows += [(60, None, 1), (2000, [None] * dims, 1), (2020, [math.nan] + [0.0] * (dims - 1), 1), (2040, [math.inf] + [0.0] * (dims - 1), 1)]
    rows += [(80, [], 1), (2060, [], 1), (2080, [1.0, -2.0, 3.0, -4.0], 1), (2100, [0.5, 0.25, -1.0, 2.0], 1), (2120, [-0.0] * dims, 1)]
    return rows


def integers(vector, scale):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(float(np.float32(x)) * scale) for x in vector]


# --- exact search ----------------------------------------------------------------------------


def best_by_hand(rows, every=20, k=20, scale=64):
    whole = [(i, integers(v, scale)) for i, v, _ in rows]
    out = Counter()
    for a, (query, x) in enumerate(whole):
        if x is None or query is None or query % every:
            continue
        scores = sorted(
            (-sum(p * q for p, q in zip(x, y, strict=True)), i is None, i or 0)
            for b, (i, y) in enumerate(whole) if a != b and y is not None and len(x) == len(y)
        )
        for rank, (score, null, i) in enumerate(scores[:k], 1):
            out[query, rank, None if null else i, -score] += 1
    return out


@pytest.mark.parametrize(("block", "chunk", "wave"), [(4096, 512, 1 << 24), (7, 3, 1 << 24), (50, 5, 1000)])
def test_search_against_brute_force(spark, block, chunk, wave):
    rows = awkward(block, n=120)
    found = exact_search.top_k(frame(spark, rows), wave_bytes=wave, block=(block, chunk)).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == best_by_hand(rows)


def test_search_with_large_and_negative_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12) * 10.0 ** (i % 8) - 3, 0) for i in range(200)]
    found = exact_search.top_k(frame(spark, rows)).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == best_by_hand(rows)


def test_search_on_few_rows(spark):
    assert exact_search.top_k(frame(spark, [])).collect() == []
    assert exact_search.top_k(frame(spark, [(0, [1.0, 2.0], 1), (None, None, None)])).collect() == []
    two = exact_search.top_k(frame(spark, [(0, [1.0, 2.0], 1), (3, [1.0, -2.0], 1)])).collect()
    assert [tuple(r) for r in two] == [(0, 1, 3, -3 * 64 * 64)]
    with pytest.raises(Exception, match="too large"):
        exact_search.top_k(frame(spark, [(0, [3e30] * 4, 1), (1, [3e30] * 4, 1)])).collect()


def test_cutoff_leaves_few_entries(spark):
    """Phase 2 passes fewer entries on than there are pairs, and the lists of phase 1 alone do not answer."""
    stored = materialize(vectors.integer_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"), 64))
    rows = stored.where("vec_id % 20 = 0").toArrow()
    sent = exact_search.Queries(rows)
    batches = [b for b in stored.select("row", "vec_id", "ints").toArrow().to_batches() if b.num_rows]
    lists = list(exact_search._local_lists(lambda: sent, 20, exact_search.BLOCK)(batches))[0]
    cutoff = np.full(rows.num_rows, -(1 << 62), np.int64)
    scores = defaultdict(list)
    for q, s in zip(lists.column("q").to_pylist(), lists.column("score").to_pylist(), strict=True):
        scores[q].append(s)
    for q, found in scores.items():
        cutoff[q] = sorted(found)[-20]
    true = queries.QUERIES["op12_exact_search"](spark, SF).where("rank = 20").toPandas().set_index("query_id")["score"]
    exact = np.array([true[i] for i in rows.column("vec_id").to_pylist()])
    assert (cutoff <= exact).all() and (cutoff < exact).any() and (cutoff > 0).all()


# --- vector codes ----------------------------------------------------------------------------


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    whole = [(i, integers(v, 1024), label) for i, v, label in rows]
    whole = sorted((x for x in whole if x[1]), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    whole = [x for x in whole if len(x[1]) == len(whole[0][1])]
    width = len(whole[0][1]) // parts
    points = np.array([x[1] for x in whole], np.int64).reshape(len(whole), parts, width)
    books = points[:entries].copy()
    for k in range(rounds + 1):
        distance = ((points[:, None] - books[None]) ** 2).sum(axis=3)
        place = distance.argmin(axis=1)
        if k < rounds:
            for p in range(parts):
                for e in set(place[:, p].tolist()):
                    books[e, p] = points[place[:, p] == e, p].sum(axis=0) // (place[:, p] == e).sum()
    error = distance.min(axis=1).sum(axis=1)
    by_label = defaultdict(int)
    for x, own in zip(whole, error.tolist(), strict=True):
        by_label[x[2]] += own
    digest = hashlib.sha256(",".join(map(str, books.transpose(1, 0, 2).reshape(-1).tolist())).encode()).hexdigest()
    return Counter(
        (x[0], "".join(f"{e:02x}" for e in own), err, by_label[x[2]], digest)
        for x, own, err in zip(whole, place.tolist(), error.tolist(), strict=True)
    )


@pytest.mark.parametrize(("n", "dims", "block"), [(420, 8, 128), (300, 4, 5), (90, 12, 16)])
def test_codes_against_brute_force(spark, n, dims, block):
    rows = awkward(n, n, dims)
    if dims == 4:
        rows = [r for r in rows if r[0] not in (2080, 2100)]
    found = vector_codes.vector_codes(frame(spark, rows), block).collect()
    assert Counter(tuple(r) for r in found) == codes_by_hand(rows)


def test_codes_on_few_rows(spark):
    assert vector_codes.vector_codes(frame(spark, [])).collect() == []
    assert vector_codes.vector_codes(frame(spark, [(1, None, 1), (2, [], 1)])).collect() == []
    one = [(None, [0.5, -0.5, 1.0, -1.0], None)]
    assert Counter(tuple(r) for r in vector_codes.vector_codes(frame(spark, one)).collect()) == codes_by_hand(one)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(frame(spark, [(1, [1.0] * 5, 1)]))
    with pytest.raises(OverflowError, match="too large"):
        vector_codes.vector_codes(frame(spark, [(1, [1e30] * 4, 1), (2, [-1e30] * 4, 1)]))


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(2)
    sizes = []
    for _ in range(300):
        entries = rng.integers(-20, 20, (64, 3))
        points = rng.integers(-20, 20, 3) + rng.integers(0, 5, (10, 3))
        left = vector_codes.shortlist(points.min(axis=0), points.max(axis=0), entries)
        distance = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        place, error = vector_codes.nearest(points, entries[left])
        assert (left[place] == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
        sizes.append(len(left))
    assert np.mean(sizes) < 16


def test_hilbert_curve_visits_neighbours():
    side = np.arange(16)
    for dims in (2, 3):
        cells = np.stack(np.meshgrid(*[side] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = vector_codes.hilbert_keys(cells, 0, 15)
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_many_equal_vectors_are_many_blocks(spark):
    rows = [(i, [0.5, 0.5, 0.5, 0.5], 1) for i in range(1000)] + [(2000 + i, [i / 100, 0, 0, 0], 2) for i in range(500)]
    kept = materialize(vectors.integer_vectors(frame(spark, rows), 1024))
    found = vector_codes.blocks(kept, 10)
    assert found.groupBy().sum("n").first()[0] == 4 * 1500 and found.selectExpr("max(n)").first()[0] == 10
    # the equal ones need no kernel: the box is a point
    same = found.where("n = 10 AND low = high").count()
    assert same >= 4 * 95


# --- filter audit ----------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audit_by_hand(docs, labels):
    failed = []
    for doc_id, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        copy = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs)
        failed.append((source or "", doc_id, {
            name for name, fails in (
                ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
                ("C", 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)), ("D", any(c in "#$%&*|" for c in text)), ("E", copy),
            ) if fails
        }))
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    out = {}
    for part in {p for p, _, _ in failed}:
        own = [(i, f) for p, i, f in failed if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for step, name in enumerate(order, 1):
                removed = [x for x in left if name in x[1]]
                redundant = sum(name in f for _, f in gone)
                left, gone = [x for x in left if name not in x[1]], gone + removed
                shapley[name] += len(removed)
                out[part, order, step] = [
                    len(left), len(removed), redundant, sum(f == {name} for _, f in own),
                    sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed),
                ]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(shapley[order[step - 1]])
    return {(*key, *figures) for key, figures in out.items()}


LONG = " ".join(f"word{i}" for i in range(60))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (None, LONG, "a"), (None, LONG, None), (0, "short", "a"),
    (4, "", "a"), (5, None, "a"), (6, "", ""), (7, None, None), (None, None, None), (8, "a " * 80, "b"), (9, "SHOUT " * 60, "b"),
    (10, LONG + " 5 $", "c"), (11, "x" * 100_000, "c"), (12, LONG.upper(), "c"), (13, "ÄÖÜ" + LONG, "c"), (14, LONG + "\n#", "c"),
    (14, "another text of the same id", "c"), (15, LONG, "a"), (16, " \t\n", "d"), (17, "SHOUT | " * 60, "d"), (18, "SHOUT | " * 60, "d"),
]
LABELS = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (3, None, 1), (9, 1, 1), (9, 1, 1), (None, 1, 1), (14, 1, None), (18, 1, 1), (99, 1, 1), (0, None, None)]


def audited(spark, docs, labels, parts=filter_audit.PARTS):
    rows = [(*d, 1, "x", 2, "y", 3) for d in docs]
    left = spark.createDataFrame(rows, "doc_id long, text string, source string, n long, part string, failed int, joined string, good int")
    right = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")
    return filter_audit.filter_audit(left.repartition(4), right, parts)


def test_audit_against_brute_force(spark):
    found = audited(spark, DOCS, LABELS).collect()
    assert len(found) == 600 * 5 and {tuple(r) for r in found} == audit_by_hand(DOCS, LABELS)


def test_audit_of_few_rows(spark):
    assert audited(spark, [], LABELS).collect() == []
    assert {tuple(r) for r in audited(spark, DOCS[:3], []).collect()} == audit_by_hand(DOCS[:3], [])


def test_more_parts_than_are_made_at_once(spark):
    docs = [(i, "SHOUT" if i % 3 else LONG, f"s{i % 10}") for i in range(60)]
    assert {tuple(r) for r in audited(spark, docs, LABELS, parts=3).collect()} == audit_by_hand(docs, LABELS)


def test_equal_rows_meet_in_no_task(spark):
    docs = spark.createDataFrame([(7, LONG, "a")] * 500 + [(i, LONG, "a") for i in range(500)], "doc_id long, text string, source string")
    assert filter_audit.failed_sets(docs).selectExpr("count(*)", "sum(n)").first()[:] == (500, 1000)
