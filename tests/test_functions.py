"""Scalar functions and rule compilation against plain Python."""

import fnmatch
import os
import re

import pytest
from pyspark.sql import functions as F

from knotmeter import rules
from knotmeter.functions import matching, paths, text


def column(spark, values, expression, name="v"):
    df = spark.createDataFrame([(v,) for v in values], f"{name} string")
    return [r[0] for r in df.select(expression).collect()]


NAMES = [".env", "a.tar.gz", "x", "A.PY", "..b.c", "n.", "Dockerfile", ".gitignore", "__init__.py",
         "a.pyc", "my.git.txt", "tests", "model.bin", "train_job.py", "x.egg-info"]


def test_extension_is_splitext(spark):
    got = column(spark, NAMES, paths.extension_of(F.col("v")))
    assert got == [os.path.splitext(n)[1].lower() for n in NAMES]


def test_globs_are_fnmatch(spark):
    for globs in (rules.IGNORE_GLOBS, rules.PIPELINE_GLOBS):
        got = column(spark, NAMES, paths.name_matches(F.col("v"), globs))
        assert got == [any(fnmatch.fnmatchcase(n, g) for g in globs) for n in NAMES]


def test_path_is_ignored_when_any_segment_is(spark):
    values = ["a/b.py", "tests/b.py", "a/node_modules/b/c.js", ".github/x.yml", "a/x.gz", "testsuite/b.py"]
    got = column(spark, values, paths.path_ignored(F.col("v"), rules.IGNORE_GLOBS))
    assert got == [any(fnmatch.fnmatchcase(s, g) for s in v.split("/") for g in rules.IGNORE_GLOBS) for v in values]


def test_ancestors(spark):
    assert column(spark, [".", "a", "a/b/c"], paths.ancestor_dirs("v")) == [
        ["."], [".", "a"], [".", "a", "a/b", "a/b/c"]]


@pytest.mark.parametrize("size,long,short", [
    (0, "0.00 B", "0.0 B"), (1023, "1023.00 B", "1023.0 B"), (1152, "1.12 KB", "1.1 KB"),
    (1024 ** 2, "1.00 MB", "1.0 MB"), (1024 ** 5, "1.00 PB", "1024.0 TB")])
def test_human_size(spark, size, long, short):
    df = spark.createDataFrame([(size,)], "s bigint")
    assert tuple(df.select(text.human_size(F.col("s")), text.human_size(F.col("s"), True)).first()) == (long, short)


def test_line_functions(spark):
    values = ["", "a", "a\n", "a\nb", "\n\n"]
    assert column(spark, values, text.line_count(F.col("v"))) == [len(v.splitlines()) for v in values]
    body = "l1\nl2 match\nl3"
    at = body.index("match")
    assert column(spark, [body], text.line_of(F.col("v"), F.lit(at))) == [2]
    window = body[max(0, at - 5): at + 5].replace("\n", " ").strip()
    assert column(spark, [body], text.context_window(F.col("v"), F.lit(at), 5)) == [window]


def test_safe_filename(spark):
    values = ['a<b>:"/\\|?*c.txt', "x\x01y", "n" * 300 + ".TXT"]
    assert column(spark, values, text.safe_filename(F.col("v"))) == [
        re.sub(r'[<>:"/\\|?*]', "_", values[0]), "xy", "n" * 251 + ".TXT"]


def test_fenced_json(spark):
    values = ['x ```json\n{"a": 1}\n``` y', '```\n[1]\n```', ' {"b": 2} ']
    assert column(spark, values, text.fenced_json(F.col("v"))) == ['{"a": 1}', "[1]", '{"b": 2}']


def test_repo_url(spark):
    owner, name = text.repo_owner_and_name(F.col("v"))
    values = ["https://github.com/o/r.git", "git@github.com:o/r", "http://x.org/o/r"]
    assert column(spark, values, F.concat_ws("/", owner, name)) == ["o/r", "o/r", ""]


ALL_PATTERNS = sorted(
    {p for p in rules.LOADING_PATTERNS + rules.PREDICTION_PATTERNS + rules.MODEL_REFERENCE_PATTERNS}
    | {p for group in rules.GLUE_PATTERNS.values() for p in group}
    | {p for fws in rules.DETECTOR_LOADING.values() for ps in fws.values() for p in ps}
    | {p for ps in rules.DETECTOR_PREDICTION.values() for p in ps}
    | {p for fws in rules.ENDPOINT_PATTERNS.values() for ps in fws.values() for p in ps}
)
SAMPLE = (
    "m = joblib.load('a.pkl'); load_model(x) keras.models.load_model(y)\n@app.get('/a') router.post(\"/b\")\n"
    "z.predict(q).predict_proba(r) fitted.values( fittedXvalues( load() normalize( .normalize(\n"
    "path('x') re_path('y') @GET  @Path('/p') resources :users get  'z' Route::get('/r'\n"
)


def test_every_rule_counts_like_python(spark):
    df = spark.createDataFrame([(SAMPLE,)], "v string")
    row = df.select(*[F.expr(matching.count_matches("v", p)) for p in ALL_PATTERNS]).first()
    assert list(row) == [len(re.findall(p, SAMPLE)) for p in ALL_PATTERNS]
    row = df.select(*[F.expr(matching.has_match("v", p)) for p in ALL_PATTERNS]).first()
    assert list(row) == [re.search(p, SAMPLE) is not None for p in ALL_PATTERNS]


def test_matching_lines_counts_a_line_once(spark):
    body = "a.TO_JSON(b).to_csv(c)\nnothing\nx.to_dict(y)"
    expression = F.expr(matching.matching_lines("lower(v)", rules.GLUE_PATTERNS["conversions"]))
    assert column(spark, [body], expression) == [2]
