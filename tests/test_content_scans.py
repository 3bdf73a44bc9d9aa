"""What full_analysis does with each text: one scan for many words, against the plain way."""

import pytest
from pyspark.sql import functions as F

from knotmeter import rules
from knotmeter.functions import matching
from knotmeter.operators import endpoints, features, history, inventory, models
from knotmeter.plans import corpus

TEXTS = [
    None, "", " on,", "on,", "x on", "x on, by,this, this. of.of in.", " on,, by, on", "a this.this, this,. on", "a\n on,\n\n in.", " é on, ü ",
    " said on, and of. to. in. that, \U0001f600 la, de,", "  on,   by,", "all, the, rest. ends with this", " und, die, der, que, le,",
]


def plain(column, words):
    for word, code in words:
        column = f"replace({column}, {matching.quoted(word)}, {matching.quoted(code)})"
    return column


@pytest.mark.parametrize("words", [corpus.CODE_WORDS, corpus.POLYGLOT_WORDS])
def test_words_are_replaced_in_one_scan(spark, words):
    expression = corpus.as_code("v", words)
    df = spark.createDataFrame([(t,) for t in TEXTS], "v string")
    for got, wanted in df.selectExpr(expression, plain("v", words)).collect():
        assert got == wanted
    assert expression.count("replace(") < 2
    # the order does not matter, as the words hold no other blank and no code makes a word
    for word, code in words:
        assert word[0] == " " and word[1:-1].isalpha() and not word[-1].isalnum()
        assert code[0] == code[-1] == "\n" and not any(w in code for w, _ in words)


def test_heads_of_calls_hold_every_call(spark):
    groups = [rules.LOADING_PATTERNS, rules.PREDICTION_PATTERNS, *rules.GLUE_PATTERNS.values()]
    patterns = [p for g in groups for p in g if matching.is_call(matching.literal_of(p))]
    literals = [matching.literal_of(p) for p in patterns]
    texts = ["", "(", "load(", "x" * 99 + "tf.keras.models.load_model((load(\n(load(", "joblib.load (", "load", *literals, "é".join(literals), "".join(literals)]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    heads = df.selectExpr("v", f"{matching.call_heads('v', literals)} AS heads")
    for v, *counts in heads.select("v", *[F.expr(matching.count_matches("heads", p)) for p in patterns]).collect():
        assert counts == [v.count(x) for x in literals]
    # not a call: no bracket at its end, or another one before
    assert not any(matching.is_call(x) for x in ("(", "preprocessing.", "f(x(", "f(x)", "f\n(", None))


def test_glue_lines_behind_their_last_characters(spark):
    text = "a.to_json(b).to_csv(c)\n\n.to_json\n(x\npreprocessing.a\nx.Preprocessing\npd.dataframe(.reshape("
    for group, lines in zip(rules.GLUE_PATTERNS.values(), (2, 1, 1)):
        lowered = [p.lower() for p in group]
        heads = matching.call_heads("v", [matching.literal_of(p) for p in lowered])
        plain = f"regexp_count(v, {matching.quoted(matching.alternation(lowered) + '[^\\n]*')})"
        df = spark.createDataFrame([(text,)], "v string")
        row = df.selectExpr(matching.matching_lines("v", group), matching.matching_lines("v", group, heads), plain).first()
        assert tuple(row) == (lines,) * 3


def test_texts_are_lowered_once(spark):
    files = spark.createDataFrame([("p", "a.py", 1, "Insert")], "project_id string, path string, size bigint, content string")
    facts = features.file_features(inventory.file_inventory(files))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    # one of the text, one of the heads; the others are of names
    assert plan.count("lower(coalesce(content") + plan.count("lower(text") == 1
    assert plan.count("lower(heads") == 1


def test_lines_of_commits_are_shuffled_once(spark):
    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changes = history.window_changes(corpus.commits(spark, sf), corpus.commit_files(spark, sf), corpus.AS_OF)
        plan = changes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(commit_id" in line]
    # lines and commits, by commit; none by commit and path
    assert len(dealt) == 2 and not any("path" in line.split("), ")[0] for line in dealt)
    assert "Exchange hashpartitioning(project_id" not in plan.split("SortMergeJoin", 1)[1]


def test_starts_of_patterns():
    assert matching.starts_of(r"""@app\.(get|put)\(['"]([^'"]+)['"]""") == ["@app.get(", "@app.put("]
    assert matching.starts_of(r"""path\(['"]([^'"]+)['"]""") == ["path("]
    assert matching.starts_of(r"""get\s+['"]""") == ["get"] and matching.starts_of(r"""@GET\s*@Path\(""") == ["@GET"]
    assert matching.starts_of("ab?c") == ["a"] and matching.starts_of("a(b|c)?d") == ["a"] and matching.starts_of(".a") == [""]
    assert matching.starts_of("a|b") == [""] and matching.starts_of("(?i)a") == [""] and matching.starts_of("a(b|(c|d))e") == [""]
    assert matching.starts_of(r"a\(*b") == ["a"] and matching.starts_of(r"a(b|c)\(?d") == ["ab", "ac"]


def test_calls_are_looked_for_in_heads(spark):
    texts = ["@app.route('/a')\nm = joblib.load('f.pkl')\nget '/b'\nx.GET(\"/c\")", "nothing()", None, "@GET @Path('/d')\nrouter.put('/e')"]
    files = spark.createDataFrame([("p", f"{i}.py", 1, t, None) for i, t in enumerate(texts)], "project_id string, path string, size bigint, content string, modified timestamp")
    tree = inventory.file_inventory(files)
    found = endpoints.endpoint_hits(tree)
    assert sorted({(r.path, r.method, r.endpoint) for r in found.collect()}) == [
        ("0.py", "GET", "/a"), ("0.py", "GET", "/b"), ("3.py", "GET", "/d"), ("3.py", "PUT", "/e")]
    refs = models.detect_model_code_refs(tree)
    assert [(r.path, r.name) for r in refs.collect()] == [("0.py", "f.pkl")]
    for rows in (found, refs):
        assert "AS heads" in rows._jdf.queryExecution().executedPlan().toString()
