import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from knotmeter.session import build_session, drop_tables  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_tables(session)


CORPUS = [
    ("requirements.txt", "flask\ntorch==2.0\n# note\n"),
    ("app.py", "from flask import Flask\n@app.route('/a')\ndf = pd.DataFrame(rows)\n"),
    ("svc_a/requirements.txt", "flask>=2\nscikit-learn\n"),
    (
        "svc_a/app.py",
        "import joblib\nimport sklearn\nm = joblib.load('fraud.pkl')\n@app.get('/score')\n"
        "y = m.predict(x)\nsave(y)\n",
    ),
    ("svc_a/fraud.pkl", None),
    ("svc_a/README.md", "Uses fraud model\n"),
    ("svc_b/package.json", '{"dependencies":{"express":"^4"},"devDependencies":{"jest":"^29"}}'),
    ("svc_b/index.js", "app.get('/b', h)\nfetch('http://svc_a/score')\nload('fraud.pkl')\n"),
    (
        "svc_b/train/train_job.py",
        "import joblib\nschedule.every()\nif a: pass\nif b: pass\nmodel.fit(x)\nrows = select(q)\n",
    ),
    ("tests/test_x.py", "assert True\n"),
    (".gitignore", "*.pyc\n"),
]


@pytest.fixture(scope="session")
def corpus(spark):
    rows = [
        ("p1", path, 2048 if text is None else len(text), "2024-01-01 00:00:00", text)
        for path, text in CORPUS
    ]
    return spark.createDataFrame(
        rows, "project_id string, path string, size bigint, modified string, content string"
    ).selectExpr("project_id", "path", "size", "timestamp(modified) AS modified", "content")


@pytest.fixture(scope="session")
def facts(corpus):
    from knotmeter.plans.tiers import Facts

    return Facts(corpus)
