"""The operators against brute force, on awkward rows and on the smallest data set."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F  # noqa: E402

from knotmeter.llm import (  # noqa: E402
    common, fingerprints, html_text, mixing, near_dups, oracle, packing, pii, quality, queries, sharding, substrings, tokens, training_order,
)
from knotmeter.session import materialize  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LINE = " ".join(f"word{i}" for i in range(60))
# nulls, empty and blank texts, equal rows, equal ids, odd blanks, long and short texts, one long word
AWKWARD = [
    (1, "a b c", "s"), (1, "a b c", "s"), (1, "other text of the same id", "s"), (None, None, None), (None, "text without id", None),
    (2, "", "s"), (3, None, "t"), (4, " \t\n\x0b ", "t"), (5, "one", "u"), (6, "One", "u"), (7, "ünï code   wörds\x85x", "v"),
    (8, LINE, "hot"), (9, "x " + LINE + " y", "hot"), (10, LINE.upper(), "hot"), (11, "w" * 5000, "hot"), (12, "a " * 4000, "hot"),
    (13, "x\n\ny  z\n", "hot"), (14, "\nleading", "hot"), (15, "tail\n", "hot"), (-5, "minus " * 50, "hot"), (16, LINE + "\n" + LINE, "hot"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, s, "x", 0, 1, 2, "r", "b") for i, t, s in AWKWARD]
    # columns that the operators might use inside
    ddl = "doc_id long, text string, source string, lang string, n_chars long, k1 long, k2 int, row string, bucket string"
    return materialize(spark.createDataFrame(rows, ddl))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(awkward):
    return materialize(awkward.where("false"))


def words(text):
    return WORD.findall(text or "")


# --- helpers ---------------------------------------------------------------------------------


def test_words_are_those_of_the_pattern():
    texts = [t for _, t, _ in AWKWARD]
    found = common.Words(pa.array(texts, pa.string()))
    cut = [[] for _ in texts]
    for row, start, end in zip(found.row, found.starts, found.ends, strict=True):
        cut[row].append(found.data[start:end].tobytes().decode())
    assert cut == [words(t) for t in texts]
    all_words = [w for row in cut for w in row]
    assert len(set(found.hashes(chunk=64).tolist())) == len(set(all_words))
    assert (found.hashes(chunk=64) == found.hashes()).all()


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = common.components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()
    got = {r["node"]: r["component"] for r in found}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_ranked_is_gapless(spark):
    df = materialize(spark.range(5000).selectExpr("id % 3 AS g", "id AS x"))
    rows = common.ranked(df, ["g"], ["x"], "n", 5000, bucket_rows=100).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["g"]].append(r["n"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(rows) == 5000


def test_tokens_are_those_of_the_library():
    import random

    encoder = tokens.Encoder(limit=50)
    rng = random.Random(1)
    texts = [t or "" for _, t, _ in AWKWARD] + ["a  b", " a", "a ", "it's  \t x", "a \nb", "<|endoftext|> x", "1 2,3.", "a b", "\n", "\n\na"]
    texts += ["".join(rng.choice(["a", "b ", " ", "\n", "'s", "é", "7", "!", " ", "word"]) for _ in range(30)) for _ in range(300)]
    for _ in range(2):
        assert encoder.encode(texts) == encoder.whole(texts)


# --- registered queries against SQL ------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(oracle.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


# --- op1 ---------------------------------------------------------------------------------------


def check_mix(rows, docs):
    sources = defaultdict(int)
    for r in docs:
        sources[r["source"]] += len(words(r["text"]))
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    # shares by weight, until none is above its stop
    target, left = {}, dict(weight)
    rest = float(sum(sources.values()))
    while left:
        level = rest / sum(left.values())
        stopped = [s for s in left if 3 * sources[s] <= level * left[s]]
        for s in stopped or list(left):
            target[s] = float(3 * sources[s]) if stopped else level * left[s]
            rest -= target[s]
            del left[s]
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sources[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_mixing(awkward, docs, nothing):
    for table in (awkward, docs):
        rows = mixing.mixed_documents(table).collect()
        check_mix(rows, table.collect())
        again = mixing.mixed_documents(table.repartition(5)).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mixed_documents(nothing).count() == 0


def test_schedule_stays_near_the_weights(docs):
    sized = materialize(mixing.sizes(docs))
    shares = materialize(mixing.targets(sized))
    slots = mixing.schedule(shares, 2000, 40).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == sorted({r["slot"] for r in slots})
    ranks = defaultdict(list)
    for r in slots:
        ranks[r["source"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())
    total = sum(r["target"] for r in shares.collect())
    seen = Counter(r["source"] for r in slots[:512])
    assert all(abs(seen[r["source"]] - 512 * r["target"] / total) < 12 for r in shares.collect())


def test_mixed_texts(awkward, docs):
    rows = mixing.mixed_texts(docs).collect()
    assert rows[0].__fields__ == docs.columns
    got, want = Counter(), Counter()
    for r in rows:
        got[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    for r in mixing.mixed_documents(docs).collect():
        want[r["doc_id"]] += r["taken"]
    assert got == +want
    assert mixing.mixed_texts(awkward).columns == awkward.columns
    taken = mixing.mixed_documents(awkward).agg(F.sum("taken")).first()[0]
    assert sum(len(words(r["text"])) for r in mixing.mixed_texts(awkward).collect()) == taken


# --- op2 ---------------------------------------------------------------------------------------


def removed(texts, width):
    rows = [words(t) for t in texts]
    count = Counter(tuple(w[i:i + width]) for w in rows for i in range(len(w) - width + 1))
    out = []
    for w in rows:
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i:i + width])] > 1 for j in range(i, i + width)}
        out.append((len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("common_anchor", [500, 1])
def test_repeats_are_removed(spark, awkward, docs, monkeypatch, common_anchor):
    monkeypatch.setattr(substrings, "COMMON_ANCHOR", common_anchor)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    for table, width in ((awkward, 10), *([(docs, 35)] if common_anchor == 1 else [])):
        rows = table.select("doc_id", "text", *common.row_key()) if table is docs else table.drop("k1", "k2").select("doc_id", "text", *common.row_key())
        got = rows.join(substrings.cut_documents(table, width), ["k1", "k2"], "left").collect()
        want = {(r["doc_id"], r["text"]): x for r, x in zip(got, removed([r["text"] for r in got], width), strict=True)}
        for r in got:
            n, kept = want[r["doc_id"], r["text"]]
            assert (r["n_removed"] or 0) == n and (r["kept"] is None or r["kept"] == kept)


def test_deduplicated_keeps_columns(awkward, nothing):
    out = substrings.deduplicated(awkward, 10)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert substrings.cut_documents(nothing, 10).count() == 0


def test_suffix_automaton_counts():
    rng = np.random.default_rng(5)
    texts = [[bytes([97 + x]) for x in rng.integers(0, 3, n)] for n in (30, 40, 25, 1, 0)]
    automaton = substrings.SuffixAutomaton()
    for t in texts:
        automaton.add(t, 1)
    automaton.finish()
    grams = Counter(tuple(t[i:i + 4]) for t in texts for i in range(len(t) - 3))
    for t in texts:
        want = {j for i in range(len(t) - 3) if grams[tuple(t[i:i + 4])] > 1 for j in range(i, i + 4)}
        assert {j for a, b in automaton.repeated(t, 4) for j in range(a, b)} == want


# --- op3 ---------------------------------------------------------------------------------------


def shingle_set(text, width):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return set(zip(*[w[k:] for k in range(width)], strict=False)) if len(w) >= width else ({tuple(w)} if w else set())


def check_groups(rows, table, width):
    nodes = [(r["doc_id"], r["text"]) for r in table]
    sets = [shingle_set(t, width) for _, t in nodes]
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(nodes):
        groups[find(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    want = sorted(((d is None, d or 0, len(s), str(least[find(i)])) for i, ((d, _), s) in enumerate(zip(nodes, sets, strict=True))))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], str(r["component_id"])) for r in rows) == want
    for r in rows:
        assert r["kept"] == (r["doc_id"] == r["component_id"] if r["component_id"] is not None else True)


def test_near_duplicates(awkward, nothing):
    check_groups(near_dups.near_duplicates(awkward, 2).collect(), awkward.collect(), 2)
    assert near_dups.near_duplicates(nothing, 2).count() == 0


def test_many_variants_of_a_text(spark):
    """One base with variants at, above and below the threshold, so that buckets span many components."""
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.choice(120, int(rng.integers(0, 16)), replace=False):
            w[k] = f"v{i}_{k}"
        rows.append((i, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    check_groups(near_dups.near_duplicates(table, 2).collect(), table.collect(), 2)


@pytest.mark.parametrize(("salts", "rows"), [(64, 256), (4, 3), (1, 1)])
def test_a_hub_with_a_third_of_all_rows(spark, monkeypatch, salts, rows):
    """A text with 150 near copies, variants that reach each other only through others, and texts that share a passage."""
    monkeypatch.setattr(near_dups, "SALTS", salts)
    monkeypatch.setattr(near_dups, "SALT_ROWS", rows)
    rng = np.random.default_rng(5)
    base, passage = [f"h{i}" for i in range(80)], [f"p{i}" for i in range(40)]
    table = []
    for i in range(450):
        w = list(base)
        if i % 3 == 0:
            w[int(rng.integers(80))] = f"n{i}"
        elif i % 3 == 1:
            for k in rng.choice(80, int(rng.integers(3, 9)), replace=False):
                w[k] = f"v{i}_{k}"
        else:
            w = [*passage, *[f"o{i}_{k}" for k in range(int(rng.integers(5, 60)))]]
        table.append((i, " ".join(w)))
    table = spark.createDataFrame(table, "doc_id long, text string")
    check_groups(near_dups.near_duplicates(table, 2).collect(), table.collect(), 2)


def test_verification_of_very_long_texts(spark):
    """Pairs of texts that fill many slices, with the hub's text in an earlier one."""
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(0, long), (1, long + " end"), (2, "start " + long), (3, long[: len(long) // 2]), (4, "")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_one_of_a_group_stays(awkward):
    kept = near_dups.kept_documents(awkward)
    rows = kept.collect()
    assert kept.columns == awkward.columns
    assert len({(r["doc_id"], r["text"]) for r in rows}) == len(rows)
    assert sum(r["text"] == "a b c" for r in rows) == 1 and sum(r["doc_id"] in (5, 6) for r in rows) == 1


def test_one_of_a_group_stays_whatever_its_ids(spark):
    """Near copies that all have a null id, or that share the smallest id."""
    base = [[f"g{g}w{i}" for i in range(100)] for g in range(3)]
    texts = [[" ".join([*b, f"end{k}"]) for k in range(3)] for b in base]
    rows = [(None, t) for t in texts[0]] + [(7, t) for t in texts[1]] + [(None, texts[2][0]), (9, texts[2][1]), (8, texts[2][2])]
    got = near_dups.kept_documents(spark.createDataFrame([*rows, (None, None), (7, "")], "doc_id long, text string")).collect()
    assert sorted(((r["text"] or "")[:2], str(r["doc_id"])) for r in got) == [("", "7"), ("", "None"), ("g0", "None"), ("g1", "7"), ("g2", "8")]
    with pytest.raises(ValueError):
        near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=50)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    shared = rng.integers(1, 2**63, 160).astype(np.uint64)
    errors = []
    for _ in range(60):
        a = np.unique(np.concatenate([shared[:80], rng.integers(1, 2**63, 40).astype(np.uint64)]))
        b = np.unique(np.concatenate([shared[:80], rng.integers(1, 2**63, 40).astype(np.uint64)]))
        s = near_dups.super_min_hash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        errors.append((s[0] == s[1]).mean() - 80 / 160)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    whole = near_dups.super_min_hash(shared, np.array([0, 160]))
    assert (near_dups.super_min_hash(shared, np.array([0, 160]), chunk=7) == whole).all()


# --- op4 ---------------------------------------------------------------------------------------


def test_fingerprints(awkward, docs, nothing):
    for table in (awkward, docs):
        rows = fingerprints.fingerprints(table).collect()
        assert len(rows) == table.count()
        by_text = defaultdict(set)
        texts = {}
        if table is docs:
            texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
            ids = sorted(texts, reverse=True)
            following = dict(zip(ids, ids[1:] + ids[:1], strict=True))
            own = {r["doc_id"]: r["fingerprint"] for r in rows}
            for r in rows:
                text, other = texts[r["doc_id"]], texts[following[r["doc_id"]]]
                half = len(text) // 2
                new = text[:len(text) - half] + other[:half]
                assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
                assert r["near_next"] == fingerprints.likeness(own[r["doc_id"]], own[following[r["doc_id"]]])
                by_text[text].add(r["fingerprint"])
            assert all(len(x) == 1 for x in by_text.values())
            assert np.mean([r["near_edited"] for r in rows]) > 0.4 > 0.2 > np.mean([r["near_next"] for r in rows])
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.fingerprints(nothing).count() == 0


def test_equal_pairs_and_chunks(monkeypatch):
    data = np.frombuffer((LINE * 3).encode(), np.uint8)
    w = fingerprints.WINDOW
    got = fingerprints.equal_pairs(data)
    for i in range(0, len(data) - w + 1, 17):
        part = data[i:i + w].tolist()
        assert got[i] == sum(part[a] == part[b] for a in range(w) for b in range(a))
    rank = fingerprints.ranks(np.bincount(got, minlength=fingerprints.PAIRS + 1))
    whole = fingerprints.features(data, rank)
    monkeypatch.setattr(fingerprints, "CHUNK", 200)
    assert (fingerprints.features(data, rank) == whole).all()


def test_only_the_empty_text_has_no_features(docs, monkeypatch):
    rng = np.random.default_rng(3)
    prose = " ".join(r["text"] or "" for r in docs.orderBy("doc_id").limit(60).collect()).encode()
    data = np.frombuffer(prose, np.uint8)
    rank = fingerprints.ranks(np.bincount(fingerprints.equal_pairs(data), minlength=fingerprints.PAIRS + 1))
    cuts = [prose[at:at + n] for n in range(1, 140) for at in rng.integers(0, len(prose) - 140, 20)]
    spam, buy, many = b"spam " * 2000, b"buy now! " * 2000, b"a" * 5000
    lists = [b"".join(b"%d. item\n" % i for i in range(3000)), b"- \n" * 500, b"----------\n" * 300]
    texts = [*cuts, spam, buy, many, *lists, prose[:4000] + spam + prose[4000:9000]]
    got = fingerprints.digests(texts, rank)
    assert all(got) and fingerprints.digests([b""], rank) == [b""]
    side_by_side = [fingerprints.features(np.frombuffer(x, np.uint8), rank) for x in texts]
    assert fingerprints.chains(side_by_side) == got
    own = dict(zip(texts, got, strict=True))
    assert fingerprints.likeness(own[spam], own[buy]) < 0.2 and fingerprints.likeness(own[spam], own[many]) < 0.2
    assert fingerprints.likeness(own[spam], fingerprints.digests([spam[:3001]], rank)[0]) > 0.9
    # lines before a list do not change which of its windows are features
    some = fingerprints.features(np.frombuffer(b"0. another\n" + lists[0], np.uint8), rank)
    assert np.isin(some, fingerprints.features(np.frombuffer(lists[0], np.uint8), rank)).mean() > 0.9
    for chunk in (200, 1000):
        monkeypatch.setattr(fingerprints, "CHUNK", chunk)
        for text in texts[-7:]:
            whole = side_by_side[texts.index(text)]
            assert (fingerprints.features(np.frombuffer(text, np.uint8), rank) == whole).all()


def test_copies_are_found_wherever_they_stand():
    rng = np.random.default_rng(5)
    numbers = [rng.integers(0, 2**63, fingerprints.FULL * n).astype(np.uint64) for n in (40, 3, 3)]
    head, own, other = numbers
    copied, short, unlike = fingerprints.chains([np.concatenate([head, own, head]), own, other])
    assert fingerprints.likeness(short, copied) == fingerprints.likeness(copied, short) == 1.0
    assert fingerprints.likeness(unlike, copied) < 0.2
    # the filters of the copy begin elsewhere: half of each lies in one filter of the longer chain
    shifted = fingerprints.chains([np.concatenate([head[:-fingerprints.FULL // 2], own, head])])[0]
    assert fingerprints.likeness(short, shifted) > 0.4


# --- op5 ---------------------------------------------------------------------------------------


def test_shards(awkward, docs, nothing):
    for table in (awkward, docs):
        rows = sharding.sharded_documents(table, sharding.regular_tree(24), sharding.regular_tree(25)).collect()
        want = Counter((str(r["doc_id"]), len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in table.collect())
        assert Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 24)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.sharded_documents(nothing, sharding.regular_tree(24)).count() == 0


def test_changed_weights_move_rows_of_their_shard_only(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.regular_tree(24)
    heavier = [(a, b, s, 3.0 if s == 7 else w) for a, b, s, w in tree]
    both = sharding.assign(sharding.assign(keys, "doc_id", tree), "doc_id", heavier, "after")
    moves = both.where("shard <> after").groupBy("after").count().collect()
    assert [r["after"] for r in moves] == [7]
    sizes = {r["after"]: r["count"] for r in both.groupBy("after").count().collect()}
    assert abs(sizes[7] - 20_000 * 3 / 26) < 250 and max(abs(n - 20_000 / 26) for s, n in sizes.items() if s != 7) < 150
    for n in (1, 12, 39):
        grown = sharding.assign(sharding.assign(keys, "doc_id", sharding.regular_tree(n)), "doc_id", sharding.regular_tree(n + 1), "after")
        assert grown.where(f"shard <> after AND after <> {n}").count() == 0


# --- op6 ---------------------------------------------------------------------------------------


def test_article_text():
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li>Menu</ul></nav><div class='cookie-notice'>Ok?</div>"
        "<article><header><h1>A &amp; B</h1></header><p>One\n  two <b>three<p>Four&nbsp;five<br>six<script>var a='</p>';</script>"
        "<div class=ad>Buy</div><form>Name <input></form><aside>Side</aside><!-- <p>x --><p hidden>no</p><p title='a>b'>seven</p>"
        "<section id='comments'><p>First!</p></section></article><footer>Foot</footer></body>"
    )
    assert [t for t, zone in html_text.page_blocks(page) if zone == html_text.ARTICLE] == ["A & B", "One two three", "Four five", "six", "seven"]


def test_pages_without_article_lose_what_they_share(spark):
    def body(i):
        return " ".join(f"t{(i * 7919 + k * k * 31 + k) % 5003}" for k in range(60))

    menu, foot = "Home News Sport Weather Travel More Shop", "Copyright by the example company all rights reserved"
    rows = [(i, f"http://h.example/{i}", f"<body><div>{menu}</div><div>{body(i)}</div><div>{foot}</div>") for i in range(12)]
    rows += [(50, None, None), (51, "x", ""), (51, "x", ""), (52, "http://h.example/a", "<article><p>Hi &lt;b&gt;</article><p>no"), (None, "http://other/", f"<p>{menu}")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.main_texts(table).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts == {**{i: body(i) for i in range(12)}, 50: "", 51: "", 52: "Hi <b>", None: menu}
    assert html_text.main_texts(table.where("false")).count() == 0


@pytest.mark.parametrize("group_bytes", [4 << 20, 2000])
def test_repeats_count_over_the_whole_host(spark, monkeypatch, group_bytes):
    """In one group or in many: a notice on few pages goes, and copies of an article with small changes stay."""
    def body(i, n=60):
        return " ".join(f"u{(i * 7919 + k * k * 31 + k) % 50021}" for k in range(n))

    menu, notice = "Home News Sport Weather Travel More Shop", "This shop is closed for the holidays until monday morning"
    story = [body(5000 + k, 40) for k in range(4)]
    rows = [(i, [menu, body(i), *([notice] if i % 13 == 0 else [])]) for i in range(117)]
    rows += [(200 + k, [menu, f"Issue {k} of the paper", *story[:3], f"{story[3]} end{k}"]) for k in range(3)]
    rows += [(300 + k, [menu]) for k in range(2)] + [(400 + k, [menu, body(4000)]) for k in range(40)]
    want = {i: [b for b in blocks if b not in (menu, notice)] for i, blocks in rows}
    html = [(i, f"http://h.example/{i}", "".join(f"<div>{b}</div>" for b in blocks)) for i, blocks in rows]
    monkeypatch.setattr(html_text, "GROUP_BYTES", group_bytes)
    got = html_text.main_texts(spark.createDataFrame(html, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    assert {r["page_id"]: r["text"].split("\n") if r["text"] else [] for r in got} == want


def test_pages_of_the_data_set(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert got[r["page_id"]] == "\n".join(x for x in blocks if x)


# --- op7 ---------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([ \-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PERSONAL = [
    (1, "a@b.c_x@d.e mail: Jo.É@x.com 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 +1 4111 1111 1111 1111"),
    (1, "a@b.c_x@d.e mail: Jo.É@x.com 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 +1 4111 1111 1111 1111"),
    (2, "4111-1111-1111-1111 +49 (30) 1234-5678. x+1 2 é😀 4111111111111111\n+1 (743) 555-3824"), (3, None), (None, "x@y.zz"), (4, ""),
    (5, "1 2 3 4 5 " * 20_000 + "@" + "a" * 50_000), (6, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x'), (7, "9" * 30_000),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "phone" and 9 <= len(digits) <= 15)
                    or (kind == "card" and 13 <= len(digits) <= 19 and luhn(digits))):
                out.append((k, m.start(), m.end()))
    return out


def test_personal_data(spark, docs, nothing):
    odd = spark.createDataFrame(PERSONAL, "doc_id long, text string").withColumn("_text", F.lit(1)).withColumn("_spans", F.lit(2))
    for table in (odd, docs):
        texts = {r["doc_id"]: r["text"] for r in table.collect()}
        found = pii.personal_data(table).collect()
        assert len(found) == table.count()
        spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found}
        for doc_id, own in spans.items():
            assert [s for s in own if s[0] < 4] == base_spans(texts[doc_id])
        names = dict(enumerate(pii.KINDS)) | {10 + i: f"{k}_like" for i, k in enumerate(pii.KINDS)}
        clean = pii.redacted(table)
        assert clean.columns == table.columns
        for r in clean.collect():
            text, out, at = texts[r["doc_id"]], "", 0
            for start, end, name in sorted((a, b, names[k]) for k, a, b in spans[r["doc_id"]]):
                if start >= at:
                    out += text[at:start] + f"[{name}]"
                at = max(at, end)
            assert r["text"] == (None if text is None else out + text[at:])
    assert pii.personal_data(nothing).count() == 0


def test_reliable_labelers_are_found():
    """Votes drawn from known reliabilities: the fit finds who is right and the classes behind the votes."""
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.4
    right = [0.95, 0.9, 0.85, 0.8, 0.55]
    counts = Counter()
    codes = []
    for t in truth:
        votes = sum((1 << k) for k, p in enumerate(right) if (rng.random() < p) == t)
        codes.append(votes)
        for name in pii.FEATURES:
            counts[0, votes, name, votes if name == "votes" else 0] += 1
    model = pii.fit([(*k, n) for k, n in sorted(counts.items())])
    score = [model.prior[0] + model.odds["votes"][0][v] for v in codes]
    assert np.mean((np.array(score) > 0) == truth) > 0.93
    assert np.argmin(model.reliability["email"]) == 4


CUED = [
    # cues of the kind, in four languages, before numbers that fail their rule
    ("card 4111 1111 1111 1112.", ["card_like"]), ("numéro de carte bancaire : 4111111111111112", ["card_like"]),
    ("Kreditkarte 4111111111111112 und", ["card_like"]), ("su tarjeta 4111111111111112 es", ["card_like"]),
    ("das Passwort 0a1b2c3d4e5f60718293a4b5c6d7", ["secret"]), ("la clave 0A1B2C3D4E5F60718293A4B5C6D7", ["secret"]),
    ("adresse 999.1.2.3 ici", ["ip_like"]), ("CARD 4111111111111112", ["card_like"]),
    # no cue, a cue of something else, a word that only ends like one, and a cue too far away
    ("the 4111111111111112 of", []), ("order 4111111111111112 shipped", []), ("facture 4111111111111112", []),
    ("Bestellung 4111111111111112", []), ("version 999.1.2.3", []), ("wildcard 4111111111111112", []),
    ("card " + "x" * 40 + " 4111111111111112", []), ("x" * 40 + "card 4111111111111112", []),
    # base spans stay whatever stands before them
    ("order 4111111111111111 shipped", ["card"]), ("version 1.2.3.4", ["ip"]),
]


def test_added_spans_on_held_out_rows(spark):
    """Fitted on one half of the documents: in the other, secrets are found and no number that fails its rule is added without a cue."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8).select("doc_id", "text")
    half = F.col("doc_id") % 2 == 0
    model = pii.fit(pii.vote_counts(materialize(pii.with_candidates(docs.where(half), F.coalesce("text", F.lit(""))).select("_candidates"))))
    held = materialize(pii.with_candidates(docs.where(~half), F.coalesce("text", F.lit(""))).select("doc_id", pii.spans(F.col("_candidates"), model).alias("spans")))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where(~half).collect()}
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in held.collect()}
    secrets = {(d, m.start(1), m.end(1)) for d, t in texts.items() for m in re.finditer('(?i)token = "([0-9a-f]{40})"', t)}
    long_numbers = sum(not luhn(m.group()) for t in texts.values() for m in re.finditer(r"(?<![0-9])[0-9]{16}(?![0-9])", t))
    added = {(d, a, b) for d, spans in found.items() for k, a, b in spans if k >= len(pii.BASE_KINDS)}
    assert len(secrets) > 50 and long_numbers > 50
    assert secrets == added
    table = spark.createDataFrame(list(enumerate(t for t, _ in CUED)), "doc_id int, text string")
    got = pii.with_candidates(table, F.col("text")).select("doc_id", pii.joined(pii.spans(F.col("_candidates"), model)).alias("s")).collect()
    assert {r["doc_id"]: [x.split(":")[0] for x in r["s"].split(",") if x] for r in got} == dict(enumerate(k for _, k in CUED))


def test_votes_and_abstentions():
    assert pii.ballots(0b0011111) == [1, 1, 1, 1, 1] and pii.ballots(0b1000001) == [1, 0, None, 0, 0]
    assert pii.ballots(0b0100000) == [0, None, 0, 0, 0]
    model = pii.fit([])
    # nothing seen: the rule decides, or a cue beside the right shape
    score = {v: model.prior[2] + model.odds["votes"][2][v] for v in range(pii.FEATURES["votes"])}
    assert score[0b1011011] > 0 and score[0b0011110] > 0 > score[0b1011010]


# --- op8 ---------------------------------------------------------------------------------------


def test_permutation_is_one():
    for size in (1, 2, 3, 5, 64, 1000, 4097):
        got = training_order.permuted(np.arange(size), size, 99)
        assert sorted(got.tolist()) == list(range(size))
    assert (training_order.permuted(np.arange(1000), 1000, 1) != training_order.permuted(np.arange(1000), 1000, 2)).any()


def test_training_order_round_trip(awkward, nothing, tmp_path):
    length = 16
    rows = training_order.materialise(awkward, str(tmp_path / "out"), length=length, shard_slots=64).collect()
    rows.sort(key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    first = {}
    for r in rows:
        first.setdefault(r["shard"], r["slot"])
        assert r["position"] == r["slot"] - first[r["shard"]]
    starts = [first.get(s, len(rows)) for s in range(max(first) + 1)]
    records = list(training_order.read_from(str(tmp_path / "out"), starts, 0, len(rows), length))
    assert [zlib.crc32(x.tobytes()) for x in records] == [r["crc32"] for r in rows]
    later = list(training_order.read_from(str(tmp_path / "out"), starts, len(rows) // 2, 7, length))
    assert all((a == b).all() for a, b in zip(later, records[len(rows) // 2:], strict=False)) and len(later) == 7
    encoder = tokens.Encoder()
    got = Counter()
    for r, ids in zip(rows, records, strict=True):
        got[r["doc_id"], r["part"], ids[:r["n_tokens"]].tobytes()] += 1
    want = Counter()
    for r in awkward.collect():
        ids = np.frombuffer(encoder.encode([r["text"] or ""])[0], "<u4").astype("<u2").tolist() + [0]
        for part, at in enumerate(range(0, len(ids), length)):
            want[r["doc_id"], part, np.array(ids[at:at + length], "<u2").tobytes()] += 1
    assert got == want
    assert training_order.materialise(nothing, str(tmp_path / "none")).count() == 0


# --- op9 ---------------------------------------------------------------------------------------


def statistics(text):
    w = words(text)
    count = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if count[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)]


def test_forest_is_fitted_on_all_labels(spark):
    """More labels than were once taken: units and threshold are those of all of them."""
    rng = random.Random(5)
    n = 5000
    texts = [" ".join(rng.choice(["one", "two", "three#", "FOUR", "five,", "six", "s" * (1 + i % 9)]) for _ in range(20 + i % 7)) for i in range(n)]
    marks = [int(i % 9 > 0) for i in range(n)]
    texts = [t + (" ## $$ !!" * (i % 4) if not m else "") for i, (t, m) in enumerate(zip(texts, marks, strict=True))]
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    forest = quality.fit(found, spark.createDataFrame(list(enumerate(marks)), "doc_id long, quality int"), 20, 64)
    stats = quality.text_statistics(pa.array(texts))
    passed = ~quality.base_failed(stats)
    x, good = quality.features(stats)[passed], np.array(marks, bool)[passed]
    low, high = np.quantile(x[good], [0.01, 0.99], axis=0)
    np.testing.assert_allclose(forest.unit, np.maximum(high - low, quality.LEAST_SPREAD))
    scores = forest.scores(x)
    kept = np.quantile(scores[good], 1 - quality.MAX_GOOD_LOST, method="higher")
    above = scores[~good & (scores > kept)]
    assert good.sum() > 4096 and len(above) and forest.threshold == pytest.approx((kept + above.min()) / 2, rel=1e-12)


def test_quality(spark, awkward, docs, nothing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (4242, 1, 0)], "doc_id long, quality int, toxic int"))
    forest = quality.fit(docs, odd.unionByName(odd))
    for table in (awkward, docs):
        rows = quality.judged(table, forest).collect()
        want = Counter((str(r["doc_id"]), *statistics(r["text"])) for r in table.collect())
        assert Counter((str(r["doc_id"]), *[r[c] for c in quality.STATS[:5]]) for r in rows) == want
        for r in rows:
            failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
            assert r["base_failed"] == failed and not (failed and r["kept"])
        kept = quality.kept_documents(table, forest)
        assert kept.columns == table.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality.judged(nothing, forest).count() == 0
    assert quality.fit(docs, labels.where("false")) is None and quality.judged(docs, None).where("kept").count() > 0


def test_labelled_ids_that_clash(spark, docs):
    """Columns of the same names as inside, and documents that share a labelled id, give one forest whatever their order."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plain = quality.fit(docs, labels)
    clashing = docs.withColumns({"wanted": F.lit(1), "quality": F.lit("x"), "stats": F.lit(2), "n_words": F.lit(3)})
    assert quality.fit(clashing, labels).threshold == plain.threshold
    twice = docs.union(docs.withColumn("text", F.concat("text", F.lit(" and more"))))
    thresholds = {quality.fit(twice.repartition(n), labels).threshold for n in (1, 3, 7)}
    assert len(thresholds) == 1


def test_forest_on_held_out_rows(spark):
    """Fitted on the labels of one data set, judged on those of a larger one."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = quality.judged(docs, forest).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.3


def test_runs_of_one_word_are_rejected(spark):
    """No rate of them is over a fixed limit; each word stands there 5 to 8 times."""
    forest = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [" ".join(f"wort{i}" for i in range(40 * k, 40 * k + 40) for _ in range(k)) for k in (5, 6, 7, 8)]
    rows = quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), forest).collect()
    assert not any(r["base_failed"] or r["kept"] for r in rows)
    odd = pa.array(["a a b b b", None, "", "c", "c c", "c d c  d\nd"])
    stats = quality.text_statistics(odd)
    assert stats[:, quality.STATS.index("n_same")].tolist() == [3, 0, 0, 0, 1, 1]
    few, many = (quality.features(quality.text_statistics(pa.array([x * 30])))[0] for x in ("one two# ", "one two## "))
    assert (few != many).any() and few[0] == 0.5 and many[0] == 1.0


# --- op10 --------------------------------------------------------------------------------------


def test_packing(awkward, docs, nothing):
    encoder = tokens.Encoder()
    for table, capacity in ((awkward, 64), (docs, 2048)):
        rows = packing.packed_documents(table, capacity).collect()
        want = Counter()
        total = 0
        for r in table.collect():
            ids = np.frombuffer(encoder.whole([r["text"] or ""])[0], "<u4").tolist() + [0]
            total += len(ids)
            at = 0
            for piece in range(-(-len(ids) // capacity)):
                end = at + ((len(ids) % capacity or capacity) if piece == 0 else capacity)
                want[r["doc_id"], piece, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes())] += 1
                at = end
        assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == want
        sequences = defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(sequences) <= -(-total // capacity) * 1.02 + 1
    assert packing.packed_documents(nothing).count() == 0


def fewest(sizes, capacity):
    """The fewest sequences by exhaustive search."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity and bins[b] not in bins[:b]:
                place(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1:]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_reduction_never_costs_a_sequence():
    rng = np.random.default_rng(8)
    for _ in range(150):
        capacity = int(rng.integers(8, 30))
        sizes = sorted((int(x) for x in rng.integers(1, capacity + 1, int(rng.integers(1, 9)))), reverse=True)
        plan = packing.Plan(capacity, Counter(sizes))
        plan.reduce()
        rest = [x for x, n in plan.left.items() for _ in range(n)]
        assert plan.sequences + fewest(sorted(rest, reverse=True), capacity) == fewest(sizes, capacity)


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    assert [name for name, _ in p.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mix_sources", "pack_sequences"]
    at = docs
    for name, stage in p.STAGES:
        out = materialize(stage(spark, at, SF))
        if name != "pack_sequences":
            assert out.columns == docs.columns
        if name == "quality_rules":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            judged = quality.judged(at, quality.fit(at, labels))
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in judged.where("kept").collect()}
        if name == "near_duplicates":
            rows = near_dups.near_duplicates(at).collect()
            check_groups(rows, at.collect(), 5)
            assert {r["doc_id"] for r in out.collect()} == {r["component_id"] for r in rows}
        if name == "personal_data":
            assert not any(base_spans(r["text"]) for r in out.collect()) and out.count() == at.count()
        if name == "pack_sequences":
            assert out.agg(F.sum(F.when(F.col("piece") == 0, 1))).first()[0] == at.count()
        at = out
