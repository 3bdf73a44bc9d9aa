"""The driver tables re-shaped into the engine's relations.

``documents`` is prose, so its words are turned into code by a fixed table of
replacements: each text keeps its length and variety, and the real rule
catalogues find work in it.  Nothing is dropped, sampled or cut; every relation
grows with its table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotmeter.functions.matching import quoted
from knotmeter.session import spread

AS_OF = "2001-08-01"

# word as it stands in the prose -> code that replaces it
CODE_WORDS = [
    (" on,", "\nimport joblib\nm = joblib.load('model_3.pkl')\n"),
    (" by,", "\nimport torch\nmy_model = torch.load(path)\n"),
    (" for,", "\ny = m.predict(x)\nsave(y)\n"),
    (" with,", "\nfrom sklearn.base import clone\n"),
    (" from,", "\n@app.get('/score')\n@app.route('/home')\n"),
    (" as,", "\nfetch('http://svc1/score')\n"),
    (" at,", "\nclf = AutoModel.from_pretrained('base-model')\n"),
    (" are,", "\nif x: pass\nelif y: pass\n"),
    (" this,", "\ndf = pd.DataFrame(rows)\n"),
    (" this.", "\nx = x.reshape(-1)\n"),
    (" is,", "\nrows = select(query)\nmodel.fit(x)\n"),
    (" that,", "\nfrom flask import Flask\napp = Flask(__name__)\n"),
    (" was,", "\nfor i in rows:\n    def step(): pass\n"),
    (" la,", "\napp.post('/items')\nconst express = require('express')\n"),
    (" de,", "\nschedule.every_day()\n"),
    (" le,", "\n@GetMapping('/orders')\n"),
    (" que,", "\nscaler = StandardScaler()\n"),
    (" der,", "\n# TODO check model_1.h5\n"),
    (" die,", "\nwebhook.trigger(event)\n"),
    (" und,", "\nrouter.get('/u', h)\nimport React from 'react'\n"),
    (" of.", "\nsee svc2/train for details\n"),
    (" to.", "\nuses model_2 and model_0 and model_3\n"),
    (" in.", "\ncall(/svc0/)\nsvc3.com\n"),
]


PATH = """
CASE
  WHEN k = 9 THEN 'requirements.txt'
  WHEN j = 0 AND g % 2 = 0 THEN 'svc' || g || '/requirements.txt'
  WHEN j = 0 THEN 'svc' || g || '/package.json'
  WHEN j = 1 AND g % 2 = 0 THEN 'svc' || g || '/app.py'
  WHEN j = 1 THEN 'svc' || g || '/index.js'
  WHEN j = 2 THEN 'svc' || g || '/README.md'
  WHEN j = 3 THEN 'svc' || g || '/train/train_' || doc_id || '.py'
  WHEN j = 4 THEN 'svc' || g || '/core/Doc' || doc_id || '.java'
  WHEN j = 5 AND g % 3 = 0 THEN 'svc' || g || '/models/model_' || g || '.pkl'
  WHEN j = 5 AND g % 3 = 1 THEN 'svc' || g || '/models/model_' || g || '.h5'
  WHEN j = 5 THEN 'svc' || g || '/models/model_' || g || '.onnx'
  WHEN j = 6 THEN 'svc' || g || '/pipeline/step_' || doc_id || '.py'
  WHEN j = 7 THEN 'svc' || g || '/tests/test_' || doc_id || '.py'
  WHEN j = 8 AND g % 3 = 1 THEN 'svc' || g || '/core/Dockerfile'
  WHEN j = 8 THEN 'svc' || g || '/core/util_' || doc_id || '.ts'
  WHEN g % 2 = 0 THEN 'docs/doc_' || doc_id || '.md'
  WHEN g % 4 = 1 THEN 'svc' || g || '/conf/config.yaml'
  ELSE 'svc' || g || '/conf/checkpoint-' || doc_id || '.yml'
END
"""


# a second reading of the same documents: services in Go, Ruby, PHP and Java
POLYGLOT_WORDS = [
    (" on,", '\nr.GET("/items", list)\nrouter.POST("/items", add)\n'),
    (" by,", "\ne.DELETE('/items', drop)\n"),
    (" for,", "\nget '/home'\npost \"/orders\"\n"),
    (" with,", "\nresources :orders\n"),
    (" from,", "\nRoute::get('/users', 'UserController')\n"),
    (" as,", "\nRoute::resource('photos', 'PhotoController')\n"),
    (" at,", "\n@PostMapping('/pay')\n@GET @Path('/bill')\n"),
    (" is,", "\n<artifactId>spring-boot</artifactId>\n"),
    (" this,", "\nhttp.Get('http://svc1/score')\n"),
]

POLYGLOT_PATH = """
CASE
  WHEN k = 9 THEN 'pom.xml'
  WHEN j = 0 AND g % 4 = 0 THEN 'svc' || g || '/go.mod'
  WHEN j = 0 AND g % 4 = 1 THEN 'svc' || g || '/Gemfile'
  WHEN j = 0 AND g % 4 = 2 THEN 'svc' || g || '/composer.json'
  WHEN j = 0 THEN 'svc' || g || '/pom.xml'
  WHEN j = 1 THEN 'svc' || g || '/Dockerfile'
  WHEN g % 4 = 0 THEN 'svc' || g || '/cmd/f' || doc_id || '.go'
  WHEN g % 4 = 1 THEN 'svc' || g || '/app/f' || doc_id || '.rb'
  WHEN g % 4 = 2 THEN 'svc' || g || '/http/f' || doc_id || '.php'
  ELSE 'svc' || g || '/src/F' || doc_id || '.java'
END
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_code(column: str, words: list[tuple[str, str]] = CODE_WORDS) -> str:
    """The text with every word replaced by its code, all but a few words in one scan.

    The text is cut at the last characters of the words, so each piece but the last ends with a word, which the map
    turns into its code. Words that differ in their last character only are replaced one by one. A word is a blank,
    letters and a mark, and no code makes a new one, so the order of the replacements does not matter.
    """
    codes: dict[str, str] = {}
    ends = []
    for word, code in words:
        if word[1:-1] in codes:
            column = f"replace({column}, {quoted(word)}, {quoted(code)})"
        else:
            codes[word[1:-1]] = code
            ends.append(word)
    marks = "".join(sorted({re.escape(word[-1]) for word in ends}))
    behind = "|".join(f"(?<={re.escape(word)})" for word in ends)
    table = ", ".join(f"{quoted(word)}, {quoted(code)}" for word, code in codes.items())
    word = "substring_index(p, ' ', -1)"
    coded = f"left(p, length(p) - length({word}) - 1) || map({table})[{word}]"
    pieces = f"transform(ps, (p, i) -> CASE WHEN i < size(ps) - 1 THEN {coded} ELSE p END)"
    # the array around the pieces gives them a name
    cut = f"array(split({column}, {quoted(f'[{marks}](?:{behind})')}))"
    return f"element_at(transform({cut}, ps -> array_join({pieces}, '')), 1)"


def files(
    spark: SparkSession, sf_dir: str, read_content: bool = True, path: str = PATH, words: list[tuple[str, str]] = CODE_WORDS
) -> DataFrame:
    """project = source; ten documents in a row make one service directory.

    With ``read_content`` the text is rewritten in a generator, once per row;
    otherwise filters over ``content`` would each repeat the rewriting.  Without
    it the column is a plain expression, which queries that never look at the
    content prune away.
    """
    documents = table(spark, sf_dir, "documents")
    if read_content:
        documents = spread(documents.select("doc_id", "source", "n_chars", "text"))
    package_json = (
        """'{"dependencies":{"express":"^' || k || '","react":"^' || n_chars || """
        """'"},"devDependencies":{"jest":"' || doc_id || '","express":"dev' || doc_id || """
        """'"},"readme":' || substring(to_json(struct(code AS t)), 6)"""
    ).replace("code AS t", as_code("text", words) + " AS t")
    content = (
        f"CASE WHEN j = 0 AND g % 2 = 1 AND k <> 9 THEN {package_json} "
        f"ELSE {as_code('text', words)} END"
    )
    return (
        documents
        .selectExpr("doc_id", "source", "n_chars", "text", "floor(doc_id / 20) AS k")
        .selectExpr("*", "floor(k / 10) AS g", "k % 10 AS j")
        .selectExpr(
            "source AS project_id",
            f"{path} AS path",
            "n_chars AS size",
            "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, int(doc_id)) AS modified",
            f"explode(array({content})) AS content" if read_content else f"{content} AS content",
        )
    )


DOCUMENT_PATH = """
CASE doc_id % 13
  WHEN 0 THEN 'vendor/lib/f' || doc_id || '.py'
  WHEN 1 THEN 'src/tests/t' || doc_id || '.py'
  WHEN 2 THEN 'src/.env'  || doc_id || '/x.py'
  WHEN 3 THEN '.hidden/_f' || doc_id || '.md'
  WHEN 4 THEN 'data/f' || doc_id || '.pkl'
  WHEN 5 THEN 'logs/f' || doc_id || '.log'
  WHEN 6 THEN 'f' || doc_id
  ELSE 'src/d' || doc_id % 7 || '/a b/f' || doc_id || '.txt'
END
"""


def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document: hidden, ignored, binary and plain names; project = source."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return documents.selectExpr("source AS project_id", f"{DOCUMENT_PATH} AS path", "text AS content")


def polyglot_files(spark: SparkSession, sf_dir: str, read_content: bool = True) -> DataFrame:
    return files(spark, sf_dir, read_content, POLYGLOT_PATH, POLYGLOT_WORDS)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(
        table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
        )
    )
    message = F.col("o_orderpriority")
    for a, b in (
        ("1-URGENT", "Hotfix crash"), ("2-HIGH", "Add feature"),
        ("4-NOT SPECIFIED", "resolve | issue"),
    ):
        message = F.replace(message, F.lit(a), F.lit(b))
    return orders.select(
        F.concat(F.lit("src"), (F.col("o_orderkey") % 20).cast("string")).alias("project_id"),
        F.col("o_orderkey").cast("string").alias("commit_id"),
        F.concat(F.lit("dev"), F.col("o_custkey").cast("string")).alias("author"),
        F.col("o_orderdate").cast("timestamp").alias("committed_at"),
        F.concat(message, F.lit(" #"), F.col("o_orderkey").cast("string")).alias("message"),
    )


def commit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: commit, path, added and deleted lines."""
    lines = spread(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity"
        )
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    svc = F.concat(F.lit("svc"), (F.col("p_partkey") % 5).cast("string"))
    model = F.concat(svc, F.lit("/models/model_"), (F.col("p_partkey") % 5).cast("string"), F.lit(".pkl"))
    code = F.concat(
        svc, F.lit("/"), F.lower("p_type"), F.lit("/part_"), F.col("p_partkey").cast("string"), F.lit(".py")
    )
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.concat(F.lit("src"), (F.col("l_orderkey") % 20).cast("string")).alias("project_id"),
        F.col("l_orderkey").cast("string").alias("commit_id"),
        F.when(F.col("p_partkey") % 7 == 0, model).otherwise(code).alias("path"),
        F.col("l_quantity").cast("bigint").alias("added"),
        F.col("l_linenumber").cast("bigint").alias("deleted"),
    )


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by commit, so that the join with the commits needs no second shuffle
    lines = commit_lines(spark, sf_dir).repartition("commit_id", "project_id")
    return lines.groupBy("project_id", "commit_id", "path").agg(
        F.sum("added").alias("added"), F.sum("deleted").alias("deleted")
    )


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a second commit stream; the type 'error' is a bug keyword."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("project_id"),
        F.col("event_id").cast("string").alias("commit_id"),
        F.concat(F.lit("dev"), F.col("user_id").cast("string")).alias("author"),
        F.col("ts").cast("timestamp").alias("committed_at"),
        F.col("event_type").alias("message"),
    )


TOPICS = [
    "machine-learning", "deep-learning", "tensorflow", "pytorch", "mlops", "llm",
    "generative-ai", "microservices", "microservice", "service-mesh", "kubernetes", "docker",
    "istio",
]


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    topic = F.array(*[F.lit(t) for t in TOPICS])
    n = len(TOPICS)

    def pick(index):
        return F.element_at(topic, (index % n + 1).cast("int"))

    key = F.col("s_suppkey")
    return suppliers.join(nations, suppliers["s_nationkey"] == nations["n_nationkey"]).select(
        key.alias("id"),
        F.concat(F.lit("org"), F.col("s_nationkey").cast("string"), F.lit("/"), F.lower("s_name")).alias("full_name"),
        F.concat(F.lit("tools of "), F.lower("n_name")).alias("description"),
        F.floor("s_acctbal").alias("stars"),
        (key * 7 % 101).alias("forks"),
        F.array(pick(F.col("s_nationkey")), pick(F.col("s_nationkey") + 1 + key % 3)).alias("topics"),
    )


def compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    number = F.floor(key / 20).cast("string")
    name = F.concat(F.lit("svc"), number)
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("src"), (key % 20).cast("string")).alias("project_id"),
        name.alias("name"),
        F.concat(F.lit("registry/"), name, F.lit(":"), F.col("s_nationkey").cast("string")).alias("image"),
        F.array(F.concat(F.lit("80"), number, F.lit(":80"))).alias("ports"),
        F.array(F.lit("MODE")).alias("environment"),
        F.array(
            F.when(key % 3 == 0, "./Models:/m").otherwise("./data:/d"), F.lit("./logs:/l")
        ).alias("volumes"),
        F.array(F.lit("db")).alias("depends_on"),
    )


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide metrics row per customer, shaped from its orders, for the scores."""
    o = table(spark, sf_dir, "orders")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    month, year = F.month("o_orderdate"), F.year("o_orderdate")
    n = F.count("*")

    def share(condition):
        return F.count_if(condition) / n

    return o.groupBy(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("project_id")).agg(
        n.alias("services_count"),
        F.count_if(p == "1-URGENT").alias("direct_count"),
        share(p == "1-URGENT").alias("direct_ratio"),
        F.count_if(p == "2-HIGH").alias("shared_count"),
        F.count_if(s == "F").alias("pipelines_count"),
        F.count_if((s == "F") & (p != "5-LOW") & (month > 4)).alias("complex_pipelines"),
        F.count_if(month <= 4).alias("retrain_count"),
        F.count_if(s == "O").alias("models_count"),
        (F.sum(month) / n).alias("avg_impact"),
        F.count_if(p == "3-MEDIUM").alias("loops_count"),
        share((p == "4-NOT SPECIFIED") & (month > 3)).alias("glue_ratio"),
        F.count_if(p == "5-LOW").alias("hidden_count"),
        (n * 70).alias("commit_count"),
        share((s == "P") & (year > 1997)).alias("bug_rate"),
        (F.sum(month) / n + F.count_if(year == 1999)).alias("avg_change_impact"),
        F.count_if(year <= 1997).alias("top5_changes"),
        n.alias("top20_changes"),
        F.count_if(s == "F").alias("endpoint_count"),
        n.alias("dependency_count"),
        (n * 3).alias("files_count"),
        F.max(F.when(p == "2-HIGH", month)).cast("double").alias("isolated_mean"),
        F.max(F.when(p == "5-LOW", month + 4)).cast("double").alias("non_isolated_mean"),
    )
