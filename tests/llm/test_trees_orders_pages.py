"""Descending shards, orders that do not depend on splits, and pages whose text stands outside articles."""

import html
import math
import re
import sys
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F  # noqa: E402

from knotmeter.llm import html_text, mixing, quality, sharding, tokens, training_order  # noqa: E402
from knotmeter.session import materialize  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- tokens ------------------------------------------------------------------------------------


def test_tasks_of_a_worker_share_one_table(monkeypatch):
    made, plain = [], tokens.Encoder
    monkeypatch.setattr(tokens, "Encoder", lambda path: made.append(path) or plain(path))
    tokens._encoder.cache_clear()
    texts = ["the same words again and again", "and other words\nof one line", None, " a  b "]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    first, second = ([x.tolist() for _, found in tokens.encoded([batch], None, 0) for x in found] for _ in range(2))
    assert first == second == [[*plain().library.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    assert len(made) == 1
    tokens._encoder.cache_clear()


def test_a_full_table_keeps_the_words_at_hand():
    encoder = tokens.Encoder(limit=3)
    encoder.encode(["x one two three four", "x five six"])
    learned = []
    learn = encoder._learn
    encoder._learn = lambda words: learned.extend(words := list(words)) or learn(words)
    texts = ["y one two seven", "y two eight"]
    assert encoder.encode(texts) == encoder.whole(texts)
    assert sorted(learned) == ["eight", "seven"] and set(encoder.known) == {"one", "two", "seven", "eight"}


def test_words_before_different_marks_are_learned_once():
    encoder = tokens.Encoder()
    learned = []
    learn = encoder._learn
    encoder._learn = lambda words: learned.extend(words := list(words)) or learn(words)
    texts = ["x word word, word. word!? \u00e9t\u00e9; \u00e9t\u00e9\nline: 7% it's it's.", "<|endoftext|>. \u4e2d. a\u00a0 b,\u3000 c.\n\n\nd", "", "\n", "word,"]
    assert encoder.encode(texts) == encoder.whole(texts)
    assert learned.count("word") == 1 and not {"word,", "word.", "word!?", "\u00e9t\u00e9;"} & set(learned)


def test_a_full_table_keeps_words_met_again_in_other_texts():
    encoder = tokens.Encoder(limit=4)
    for texts in (["x one two"], ["x one two three"], ["x four five"], ["x six"]):
        assert encoder.encode(texts) == encoder.whole(texts)
    assert set(encoder.known) == {"one", "two", "six"}


def test_a_word_of_the_table_takes_few_bytes():
    import tracemalloc

    encoder = tokens.Encoder()
    text = pa.array([" ".join(f"w{chr(97 + i % 26)}{i:x}" for i in range(100_000))])
    encoder.encode(["warm up"])
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    encoder.encode(text.to_pylist())
    taken = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert len(encoder.known) > 99_000 and taken < 60 * 100_000


# --- op9 ---------------------------------------------------------------------------------------


def test_statistics_are_taken_of_little_text_at_once(monkeypatch):
    """Their scratch is many times the text, and a worker keeps it."""
    from types import SimpleNamespace

    sizes, plain = [], quality.text_statistics
    monkeypatch.setattr(quality, "text_statistics", lambda texts: sizes.append(sum(len(x) for x in texts.to_pylist())) or plain(texts))
    batch = pa.record_batch([pa.array(range(600)), pa.array(["some words of a text " * 500] * 600)], ["doc_id", "text"])
    docs = SimpleNamespace(columns=["doc_id", "text"], schema=None, mapInArrow=lambda task, schema: task)
    assert sum(x.num_rows for x in quality.kept_documents(docs, None)([batch])) == 0
    assert sum(sizes) == 600 * 10_500 and max(sizes) <= 1 << 20


# --- op5 ---------------------------------------------------------------------------------------


def draw(key, level, node, weight):
    seed = 42
    parts = [] if key is None else [key.to_bytes(8, "little", signed=True)]
    for data in [*parts, level.encode(), node.to_bytes(4, "little")]:
        seed = xxhash.xxh64_intdigest(data, seed)
    return -math.log(((seed >> 11) + 0.5) / 2**53) / weight


def descended(key, tree):
    nodes = tree
    for place, level in enumerate(("region", "rack", "shard")):
        weights = defaultdict(float)
        for node in nodes:
            weights[node[place]] += node[3]
        best = min(weights, key=lambda n: draw(key, level, n, weights[n]))
        nodes = [node for node in nodes if node[place] == best]
    return nodes[0][2]


UNEVEN = [(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 1, 2, 5.0), (1, 2, 3, 0.5), (2, 3, 4, 3.0), (2, 4, 5, 1.0), (2, 4, 6, 1.0)]


@pytest.mark.parametrize("tree", [UNEVEN, sharding.regular_tree(24), sharding.regular_tree(1)])
def test_draws_by_hand(spark, tree):
    rows = [(i,) for i in [None, 0, -1, 2**62, *range(5, 400)]]
    keys = spark.createDataFrame(rows, "doc_id long").withColumn("_shard_region", F.lit("kept"))
    got = sharding.descend(keys, "doc_id", tree).collect()
    assert len(got) == len(rows) and {r["_shard_region"] for r in got} == {"kept"}
    assert all(r["shard"] == descended(r["doc_id"], tree) for r in got)


def counts(keys, tree):
    return {r["shard"]: r["count"] for r in sharding.descend(keys, "doc_id", tree).groupBy("shard").count().collect()}


def test_each_level_follows_its_weights(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "doc_id")
    got = counts(keys, UNEVEN)
    for _, _, shard, weight in UNEVEN:
        assert abs(got[shard] - 40_000 * weight / 13.5) < 450


def test_moves_stay_in_the_changed_subtrees(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.regular_tree(36)  # three regions of twelve
    heavier = [(a, b, s, 4.0 if s == 7 else w) for a, b, s, w in tree]
    both = sharding.descend(sharding.descend(keys, "doc_id", tree), "doc_id", heavier, "after")
    moves = both.where("shard <> after").select(F.floor(F.col("shard") / 12).alias("a"), F.floor(F.col("after") / 12).alias("b"), "after").collect()
    assert moves and all(r["b"] == 0 for r in moves)  # into the region that grew
    assert all(r["after"] // 3 == 2 for r in moves if r["a"] == 0)  # in that region, into the rack that grew
    for n in (1, 7, 12, 24, 39):
        tree = sharding.regular_tree(n)
        both = sharding.descend(sharding.descend(keys, "doc_id", tree), "doc_id", sharding.grown_tree(tree), "after")
        moved = both.where("shard <> after")
        assert moved.where(f"after <> {n}").count() == 0
        assert abs(moved.count() - 20_000 / (n + 1)) < 350


def test_written_shards(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, sharding.regular_tree(5), path)
    back = spark.read.parquet(path)
    assert Counter(back.select(*docs.columns).collect()) == Counter(docs.collect())
    assert all(r["shard"] == descended(r["doc_id"], sharding.regular_tree(5)) for r in back.collect())
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("Shard", F.lit(1)), sharding.regular_tree(5), path)


# --- op8 ---------------------------------------------------------------------------------------


def test_order_does_not_depend_on_splits(docs, tmp_path):
    found = []
    for name, table in (("a", docs), ("b", docs.repartition(3)), ("c", docs.orderBy(F.desc("doc_id")).coalesce(1))):
        folder = f"file://{tmp_path}/{name}"
        rows = training_order.materialise(table, folder, shard_slots=64).collect()
        found.append(sorted((r["slot"], r["doc_id"], r["part"], r["crc32"], r["shard"], r["position"]) for r in rows))
    assert found[0] == found[1] == found[2]
    shards = Counter(x[4] for x in found[0])
    starts = [sum(n for s, n in shards.items() if s < shard) for shard in range(max(shards) + 1)]
    records = list(training_order.read_from(f"file://{tmp_path}/c", starts, 5, len(found[0]), 512))
    assert [zlib.crc32(x.tobytes()) for x in records] == [x[3] for x in found[0][5:]]
    # the order is that of the key, not of the ids
    assert [x[1] for x in found[0]] != sorted(x[1] for x in found[0])


def test_order_with_a_very_long_text_and_equal_rows(spark, tmp_path):
    rows = [(1, "word " * 300_000), (1, "word " * 300_000), (1, "other"), (None, None), (None, None), (0, None), (0, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("number", F.lit("clash"))
    found = [
        sorted((r["slot"], str(r["doc_id"]), r["part"], r["crc32"]) for r in training_order.materialise(x, str(tmp_path / n), shard_slots=100).collect())
        for n, x in (("a", table), ("b", table.repartition(4)))
    ]
    assert found[0] == found[1] and [x[0] for x in found[0]] == list(range(len(found[0])))


# --- op1 ---------------------------------------------------------------------------------------


def test_every_stretch_of_the_result_is_near_the_weights(docs, monkeypatch):
    rows = mixing.mixed_documents(docs).collect()
    assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in rows)
    order = sorted((r for r in rows if r["taken"]), key=lambda r: r["first_slot"])
    share = {r["source"]: r["target"] for r in rows}
    total, longest = sum(share.values()), max(r["taken"] for r in rows)
    seen, words = Counter(), 0
    for r in order:
        seen[r["source"]] += r["taken"]
        words += r["taken"]
        # a document counts as a whole at its first slot, so each source may be one document ahead
        assert all(abs(seen[s] - words * share[s] / total) <= 3 * longest for s in share)
    monkeypatch.setattr(mixing, "_point", lambda slot: F.lit(0.999))
    other = {(r["doc_id"], r["size"]): r["first_slot"] for r in mixing.mixed_documents(docs).collect()}
    assert sum(other[r["doc_id"], r["size"]] != r["first_slot"] for r in rows) > len(rows) / 2


# --- op6 ---------------------------------------------------------------------------------------


def structured(page):
    blocks = html_text._blocks(page)
    return [[b[0] for b, x in zip(blocks, html_text.states(blocks), strict=True) if x == kind] for kind in (html_text.TEXT, html_text.OPEN)]


def test_text_around_and_in_articles_is_kept():
    assert structured("<main><h1>Title</h1><p>Intro.</p><article><p>Body</p></article></main>")[0] == ["Title", "Intro.", "Body"]
    inside = (
        "<article><div class='post-header'><h1>Head</h1></div><p class='notice'>Note</p><p class=alert>Watch</p>"
        "<div class='search-results-study'>Study</div><div class='share social'>Share</div><div class='ad-slot'>Buy</div>"
        "<ul class=related-links><li>More</ul><p>End <span class=ad>ad</span> here</p><section class='comments-list'>First!</section></article>"
    )
    assert structured(inside) == [["Head", "Note", "Watch", "Study", "End", "here"], []]
    story = [f"story {i} " + "words of it " * 12 for i in range(4)]
    page = "<nav>Menu</nav>" + "".join(f"<div>{x}</div>" for x in story) + "<article class='card'>Teaser</article>"
    assert structured(page) == [[], [*(x.strip() for x in story), "Teaser"]]
    for tag in ("select", "button", "canvas", "svg", "script", "textarea", "title"):
        assert structured(f"<article><div>one <{tag}>gone</div><p>two</p></article>")[0] == ["one", "two"]
    assert structured("<body><form><nav>x</nav><article>whole page in a form</article></form>")[0] == ["whole page in a form"]
    assert structured("<h1>Site</h1><h1>Title</h1><p>Lead</p><article>Body of the page</article><p>foot</p>") == [["Body of the page"], ["Title", "Lead"]]
    assert structured("<h1>Site</h1><article><h1>Title</h1>Body</article>") == [["Title", "Body"], []]


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "</p>" * 100_000 + "x", "<b>" * 100_000 + "<p>a</p>" * 60_000, "<script>" * 120_000 + "z", "<textarea>" * 90_000,
    "<div>a" * 90_000 + "</div>" * 90_000, "<li>a<ul>" * 100_000, "<a '" * 200_000, "<a title=\">" * 100_000, "<!--" * 200_000, "&amp" * 200_000,
])
def test_long_and_deep_pages_take_linear_time(page):
    begin = time.process_time()
    structured(page)
    assert time.process_time() - begin < 10


def test_titles_that_a_host_shares_go(spark):
    story = [" ".join(f"w{i * 131 + k * k}" for k in range(40)) for i in range(9)]
    rows = [(i, f"http://h/{i}", f"<h1>The daily paper of our small town</h1><article>{story[i]}</article>") for i in range(5)]
    rows += [(10 + i, f"http://g/{i}", f"<h1>Title number {i}</h1><p>Lead {i}</p><article>{story[i]}</article>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: story[i] for i in range(5)}, **{10 + i: f"Title number {i}\nLead {i}\n{story[i]}" for i in range(4)}}


def test_search_on_pages_without_articles(spark):
    """The given pages with plain elements in place of all marked ones: what the host's pages share has to tell."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    truth = {r["page_id"]: Counter(r["text"].split()) for r in html_text.main_texts(pages).collect()}
    plain = pages.withColumn("html", F.regexp_replace("html", "(</?)(?:article|main)\\b[^>]*>", "$1div>"))
    got = {r["page_id"]: Counter(r["text"].split()) for r in html_text.main_texts(plain).collect()}
    right = sum(sum((truth[i] & got[i]).values()) for i in truth)
    recall = right / sum(sum(x.values()) for x in truth.values())
    precision = right / sum(sum(x.values()) for x in got.values())
    print(f"recall {recall:.4f} precision {precision:.4f}")
    assert recall > 0.95 and precision > 0.95


@pytest.mark.parametrize("group_bytes", [4 << 20, 1500])
def test_what_a_host_repeats_in_its_articles_goes(spark, monkeypatch, group_bytes):
    """A line in most articles of a host that no class names is boilerplate; articles that a host copies and lines on few of its pages stay."""
    def body(i):
        return " ".join(f"w{(i * 7919 + k * k * 31 + k) % 50021}" for k in range(30))

    line, quote = "Write to our paper for more stories of this kind", "a sentence that three of the many articles have in common"
    def page(*blocks):
        return "<nav>Menu of the paper</nav><article><h1>Story</h1>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"

    want = {i: ["Story", body(i), *([quote] if i < 3 else [])] for i in range(40)}
    rows = [(i, f"http://h/{i}", page(*want[i][1:], line)) for i in range(40)]
    # equal pages count once, so their text is not on most of the host's pages
    rows += [(100 + i, "http://h/copy", page(body(999), line)) for i in range(100)]
    want |= {100 + i: ["Story", body(999)] for i in range(100)}
    rows += [(300 + i, f"http://g/{i}", page(body(77), f"issue {i}")) for i in range(4)]
    want |= {300 + i: ["Story", body(77), f"issue {i}"] for i in range(4)}
    rows += [(400 + i, f"http://f/{i}", page(body(i + 500), line)) for i in range(2)]
    want |= {400 + i: ["Story", body(i + 500), line] for i in range(2)}
    monkeypatch.setattr(html_text, "GROUP_BYTES", group_bytes)
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    assert {r["page_id"]: r["text"].split("\n") for r in got} == want


# --- op9 ---------------------------------------------------------------------------------------


def test_labels_meet_statistics_and_no_texts(spark, monkeypatch):
    """However many labels there are: between the scan of the texts and their statistics nothing is shuffled."""
    plans = []
    monkeypatch.setattr(quality, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialize(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert quality.labelled_features(quality.statistics(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet")).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = plans[0].splitlines()
    begin = max(i for i, line in enumerate(lines) if "MapInArrow" in line)
    end = next(i for i in range(begin, len(lines)) if "Scan" in lines[i])
    assert "text" in lines[end] and not any("Exchange" in line or "Join" in line for line in lines[begin:end])
