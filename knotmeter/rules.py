"""Rule catalogues.

Everything here is data.  Operators take these tables as default arguments, so
a caller can pass another catalogue of the same shape.  Patterns are regular
expressions in the dialect shared by Python and Java unless noted otherwise.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# The results are defined by these lists, so they are stated
# exactly as the definition gives them.
# ---------------------------------------------------------------------------

IGNORE_GLOBS = [
    "*.pyc", "__pycache__", "*.git*", "*.idea", "*.vscode", "node_modules",
    "venv", "env", ".env", "*.log", "*.tmp", "*.cache", "*.egg-info", "build",
    "dist", "*.so", "*.dll", "*.dylib", "*.exe", "*.bin", "*.jpg", "*.jpeg",
    "*.png", "*.gif", "*.mp4", "*.mp3", "*.wav", "*.zip", "*.tar", "*.gz",
    "coverage", ".nyc_output", "__tests__", "test", "tests",
    "bower_components", "vendor",
]
SCANNER_IGNORE_GLOBS = IGNORE_GLOBS + [".gradle", ".mvn", "target", ".DS_Store"]

# language -> extensions and exact file names, first language wins
LANGUAGE_FILES = {
    "Python": [".py", "requirements.txt", "setup.py", "Pipfile"],
    "JavaScript": [".js", ".jsx", "package.json", "yarn.lock"],
    "TypeScript": [".ts", ".tsx", "tsconfig.json"],
    "Java": [".java", "pom.xml", "build.gradle", ".jar"],
    "Go": [".go", "go.mod", "go.sum"],
    "Ruby": [".rb", "Gemfile", "Rakefile"],
    "PHP": [".php", "composer.json"],
    "C#": [".cs", ".csproj", ".sln"],
    "C++": [".cpp", ".hpp", "CMakeLists.txt"],
    "Rust": [".rs", "Cargo.toml"],
    "Swift": [".swift", "Podfile"],
    "Kotlin": [".kt", "build.gradle.kts"],
    "Dart": [".dart", "pubspec.yaml"],
    "R": [".r", ".R", "DESCRIPTION"],
    "Scala": [".scala", "build.sbt"],
    "HTML": [".html", ".htm"],
    "CSS": [".css", ".scss", ".sass", ".less"],
}

SCANNER_LANGUAGE_FILES = {
    "Python": [".py", ".py3"],
    "JavaScript": [".js", ".jsx"],
    "TypeScript": [".ts", ".tsx"],
    "Java": [".java"],
    "Go": [".go"],
    "Ruby": [".rb"],
    "PHP": [".php"],
    "C#": [".cs"],
    "C/C++": [".cpp", ".c", ".h"],
    "Rust": [".rs"],
    "Swift": [".swift"],
    "Kotlin": [".kt"],
    "R": [".r", ".R"],
    "Scala": [".scala"],
    "SQL": [".sql"],
    "HTML": [".html", ".htm"],
    "CSS": [".css", ".scss", ".sass"],
    "Shell": [".sh", ".bash"],
    "YAML": [".yml", ".yaml"],
    "JSON": [".json"],
    "Markdown": [".md"],
}

# language -> (extensions, file-name indicators)
DETECTOR_LANGUAGES = {
    "Python": (
        [".py", ".py3", ".pyx", ".pxd", ".pyi", ".ipynb"],
        ["requirements.txt", "setup.py", "Pipfile", "pyproject.toml"],
    ),
    "JavaScript": (
        [".js", ".jsx", ".mjs", ".cjs"],
        ["package.json", "package-lock.json", "yarn.lock"],
    ),
    "TypeScript": ([".ts", ".tsx"], ["tsconfig.json", "typescript"]),
    "Java": (
        [".java", ".class", ".jar"],
        ["pom.xml", "build.gradle", "mvnw", "gradlew"],
    ),
    "Go": ([".go"], ["go.mod", "go.sum", "Gopkg.toml"]),
    "Ruby": ([".rb", ".erb", ".rake"], ["Gemfile", "Rakefile", "*.gemspec"]),
    "PHP": (
        [".php", ".phtml", ".php3", ".php4", ".php5", ".php7"],
        ["composer.json", "composer.lock"],
    ),
    "C#": ([".cs", ".cshtml", ".aspx", ".ascx"], [".sln", ".csproj", "packages.config"]),
    "C++": (
        [".cpp", ".hpp", ".cc", ".hh", ".cxx", ".hxx", ".c", ".h"],
        ["CMakeLists.txt", "Makefile", "*.vcxproj"],
    ),
    "Rust": ([".rs"], ["Cargo.toml", "Cargo.lock"]),
    "Swift": ([".swift"], ["Package.swift", "*.xcodeproj"]),
    "Kotlin": ([".kt", ".kts"], ["build.gradle.kts"]),
    "R": ([".r", ".R", ".Rmd"], ["DESCRIPTION", "NAMESPACE"]),
    "Scala": ([".scala", ".sc"], ["build.sbt"]),
    "HTML": ([".html", ".htm", ".xhtml"], ["index.html"]),
    "CSS": ([".css", ".scss", ".sass", ".less", ".styl"], []),
    "SQL": ([".sql", ".psql"], []),
    "Shell": ([".sh", ".bash", ".zsh", ".fish"], []),
    "Docker": ([], ["Dockerfile", "docker-compose.yml"]),
    "YAML": ([".yml", ".yaml"], []),
    "JSON": ([".json"], []),
    "Markdown": ([".md", ".markdown"], ["README.md"]),
}

PROJECT_TYPE_PATTERNS = {
    "Microservices": ["docker-compose.yml", "service", "microservice", "api-gateway"],
    "Web Application": ["package.json", "index.html", "public/", "src/"],
    "React App": ["react", "jsx", "components/", "App.js", "index.js"],
    "Python Application": ["app.py", "main.py", "flask", "django", "fastapi"],
    "ML Project": ["model.pkl", "train.py", "notebooks/", "jupyter", "tensorflow"],
    "Data Pipeline": ["etl", "pipeline", "airflow", "dags/"],
    "Library/Package": ["setup.py", "lib/", "__init__.py"],
    "Mobile App": ["AndroidManifest.xml", "Info.plist", "MainActivity.kt"],
    "Desktop App": ["main_window", "gui", "electron"],
}

DETECTOR_PROJECT_TYPES = {
    "Microservices": [
        "docker-compose.yml", "service", "microservice", "api-gateway", "eureka", "consul",
    ],
    "Web Application": [
        "package.json", "index.html", "public/", "src/", "templates/", "static/",
    ],
    "Single Page App": [
        "index.html", "App.js", "App.tsx", "components/", "routes/", "store/",
    ],
    "Mobile App": [
        "AndroidManifest.xml", "Info.plist", "MainActivity", "AppDelegate", "gradle",
    ],
    "Desktop App": ["main_window", "MainWindow", "main.cpp", "electron", "Qt"],
    "ML/AI Project": [
        "model.pkl", "train.py", "notebooks/", "jupyter", "tensorflow", "pytorch",
        "keras", "data/",
    ],
    "Data Pipeline": ["etl", "pipeline", "airflow", "dags/", "spark", "kafka", "beam"],
    "API Service": ["api/", "routes/", "controllers/", "swagger", "openapi", "postman"],
    "Library/Package": ["setup.py", "lib/", "__init__.py", "package.json", "dist/"],
    "Infrastructure": ["terraform", "kubernetes", "helm", "cloudformation", "ansible"],
}

BUILD_SYSTEMS = {
    "Maven": ["pom.xml"],
    "Gradle": ["build.gradle", "build.gradle.kts"],
    "npm": ["package.json", "package-lock.json"],
    "yarn": ["yarn.lock"],
    "pip": ["requirements.txt", "setup.py"],
    "poetry": ["poetry.lock", "pyproject.toml"],
    "Cargo": ["Cargo.toml"],
    "Go Modules": ["go.mod"],
    "Bundler": ["Gemfile"],
    "Composer": ["composer.json"],
    "MSBuild": [".csproj", ".sln"],
    "Make": ["Makefile", "makefile"],
    "CMake": ["CMakeLists.txt"],
    "Bazel": ["WORKSPACE", "BUILD"],
}

SERVICE_INDICATORS = [
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "requirements.txt",
    "package.json", "setup.py", "pom.xml", "build.gradle", "Cargo.toml", "go.mod",
    "main.py", "app.py", "index.js", "server.js", "application.py", "wsgi.py",
    "manage.py", "index.html", "service.yaml", "deployment.yaml",
]
SCANNER_SERVICE_INDICATORS = [
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "requirements.txt",
    "package.json", "setup.py", "pom.xml", "build.gradle", "Cargo.toml", "go.mod",
    "main.py", "app.py", "application.py", "wsgi.py", "manage.py", "index.js",
    "server.js", "app.js", "main.go", "main.java",
]

# first manifest present among the direct children decides the service language
SERVICE_LANGUAGE_CHAIN = [
    (["requirements.txt", "setup.py"], "Python"),
    (["package.json"], "JavaScript/Node.js"),
    (["pom.xml"], "Java (Maven)"),
    (["build.gradle"], "Java (Gradle)"),
    (["go.mod"], "Go"),
    (["Cargo.toml"], "Rust"),
    (["Gemfile"], "Ruby"),
    (["composer.json"], "PHP"),
]
SCANNER_SERVICE_LANGUAGE_CHAIN = SERVICE_LANGUAGE_CHAIN + [
    (["main.py", "app.py"], "Python"),
    (["index.js", "server.js"], "JavaScript"),
    (["main.go"], "Go"),
    (["main.java"], "Java"),
]
SCANNER_SERVICE_EXTENSION_CHAIN = [(".py", "Python"), (".js", "JavaScript"), (".java", "Java")]

MODEL_EXTENSIONS = [
    ".pkl", ".pickle", ".joblib", ".sav", ".pt", ".pth", ".ckpt", ".h5", ".hdf5",
    ".keras", ".onnx", ".pb", ".pbtxt", ".tflite", ".meta", ".mlmodel", ".mlpackage",
    ".caffemodel", ".mar", ".torchscript", ".pmml", ".xml", ".bin", ".model",
    ".data-00000-of-00001", ".weights", ".index", ".rds", ".rda", ".m", ".lite",
]
MODEL_TYPES = {
    ".pkl": "Pickle", ".pickle": "Pickle", ".joblib": "Joblib", ".sav": "Pickle/Joblib",
    ".pt": "PyTorch", ".pth": "PyTorch", ".ckpt": "Checkpoint", ".h5": "Keras/HDF5",
    ".hdf5": "HDF5", ".keras": "Keras", ".onnx": "ONNX", ".pb": "TensorFlow",
    ".tflite": "TensorFlow Lite", ".mlmodel": "CoreML", ".caffemodel": "Caffe",
    ".mar": "PyTorch MAR", ".pmml": "PMML", ".bin": "Binary Model",
    ".model": "Generic Model", ".rds": "R Model", ".rda": "R Data",
}
SCANNER_MODEL_EXTENSIONS = [
    ".pkl", ".pickle", ".joblib", ".sav", ".pt", ".pth", ".ckpt", ".bin", ".h5", ".hdf5",
    ".keras", ".onnx", ".pb", ".pbtxt", ".tflite", ".mlmodel", ".caffemodel", ".mar",
    ".torchscript", ".pmml", ".xml", ".rds", ".rda", ".model", ".weights",
]
SCANNER_MODEL_TYPES = {
    **MODEL_TYPES,
    ".pbtxt": "TensorFlow Text", ".torchscript": "TorchScript", ".xml": "XML Model",
    ".weights": "Model Weights",
}
DETECTOR_MODEL_EXTENSIONS = {
    "Pickle": [".pkl", ".pickle", ".sav"],
    "Joblib": [".joblib"],
    "PyTorch": [".pt", ".pth", ".ckpt", ".bin", ".pt.tar", ".pth.tar"],
    "TensorFlow": [".pb", ".pbtxt", ".meta", ".index", ".data-00000-of-00001"],
    "Keras": [".h5", ".hdf5", ".keras"],
    "ONNX": [".onnx"],
    "TFLite": [".tflite", ".lite"],
    "CoreML": [".mlmodel", ".mlpackage"],
    "Caffe": [".caffemodel", ".prototxt"],
    "Scikit-learn": [".pkl", ".joblib"],
    "XGBoost": [".model", ".ubj"],
    "LightGBM": [".txt"],
    "R": [".rds", ".rda"],
    "SageMaker": [".tar.gz"],
    "MLflow": [".mlflow"],
    "BentoML": [".bento"],
    "PMML": [".pmml", ".xml"],
}
MODEL_ARCHITECTURES = [
    "resnet", "vgg", "bert", "gpt", "lstm", "cnn", "rnn", "transformer",
    "efficientnet", "yolo", "ssd",
]
MODEL_VERSION_PATTERN = r"[vV]?(\d+[\._]?\d*)"
MODEL_METADATA_GLOBS = [
    "config.json", "config.yaml", "config.yml", "params.json", "hyperparameters.json",
    "checkpoint", "model.ckpt", "checkpoint-*", "training_args.json", "model_config.json",
]

# loading patterns for code references to models
MODEL_REFERENCE_PATTERNS = [
    r"joblib\.load\(", r"pickle\.load\(", r"torch\.load\(", r"load_model\(",
    r"keras\.models\.load_model\(", r"tf\.keras\.models\.load_model\(",
    r"onnx\.load\(", r"model\.load_weights\(", r"from_pretrained\(", r"pmml\.load\(",
    r"pmml\.read\(", r"readRDS\(", r"keras::load_model_hdf5\(", r"load_weights\(",
    r"mlflow\.pyfunc\.load_model\(", r"bentoml\.load\(",
]
QUOTED_MODEL_PATTERN = r"""['"]([^'"]*\.(?:pkl|pt|h5|onnx|pb|joblib|sav))['"]"""
DETECTOR_QUOTED_MODEL_PATTERN = (
    r"""['"]([^'"]*\.(?:pkl|pt|h5|onnx|pb|joblib|sav|model))['"]"""
)
PRETRAINED_PATTERN = r"""from_pretrained\(['"]([^'"]+)['"]"""
SCANNER_REFERENCE_PATTERNS = [
    r"""joblib\.load\(['"]([^'"]+\.(?:pkl|joblib))['"]""",
    r"""pickle\.load\(['"]([^'"]+\.(?:pkl|pickle))['"]""",
    r"""torch\.load\(['"]([^'"]+\.(?:pt|pth))['"]""",
    r"""keras\.models\.load_model\(['"]([^'"]+\.(?:h5|keras))['"]""",
    r"""tf\.keras\.models\.load_model\(['"]([^'"]+\.(?:h5|keras))['"]""",
    r"""onnx\.load\(['"]([^'"]+\.onnx)['"]""",
    r"""model = [\w]+\(pretrained=[Tt]rue\)""",
    r"""from_pretrained\(['"]([^'"]+)['"]""",
    r"""load_weights\(['"]([^'"]+)['"]""",
    r"""readRDS\(['"]([^'"]+\.rds)['"]""",
]

# language -> framework -> loading patterns
DETECTOR_LOADING = {
    "python": {
        "pickle": [r"pickle\.load\(", r"pickle\.loads\("],
        "joblib": [r"joblib\.load\(", r"joblib\.dump\("],
        "torch": [r"torch\.load\(", r"torch\.save\(", r"load_state_dict\("],
        "keras": [
            r"keras\.models\.load_model\(", r"load_model\(",
            r"tf\.keras\.models\.load_model\(",
        ],
        "tensorflow": [
            r"tf\.saved_model\.load\(", r"saved_model\.load\(",
            r"tf\.train\.load_checkpoint\(",
        ],
        "onnx": [r"onnx\.load\(", r"onnxruntime\.InferenceSession\("],
        "sklearn": [r"joblib\.load\(", r"pickle\.load\(", r"load\('"],
        "mlflow": [r"mlflow\.pyfunc\.load_model\(", r"mlflow\.sklearn\.load_model\("],
        "bentoml": [r"bentoml\.load\(", r"bentoml\.get\(", r"bentoml\.models\.get\("],
        "transformers": [r"from_pretrained\(", r"AutoModel\.from_pretrained\("],
    },
    "r": {
        "readRDS": [r"readRDS\(", r"load\(", r"read\.rds\("],
        "keras": [r"load_model_hdf5\(", r"keras::load_model_hdf5\("],
        "caret": [r"read\.rds\(", r"load\(\)"],
    },
    "javascript": {
        "tensorflow": [r"tf\.loadLayersModel\(", r"tf\.loadGraphModel\("],
        "onnx": [r"onnx\.load\(", r"onnx\.InferenceSession\("],
    },
    "java": {
        "dl4j": [
            r"ModelSerializer\.restoreMultiLayerNetwork\(",
            r"ModelSerializer\.restoreComputationGraph\(",
        ],
        "h2o": [r"h2o\.loadModel\(", r"Model\.load\("],
        "mllib": [r"MLModel\.load\(", r"PipelineModel\.load\("],
    },
}
DETECTOR_PREDICTION = {
    "python": [
        r"\.predict\(", r"\.predict_proba\(", r"\.transform\(", r"\.score\(",
        r"\.forward\(", r"\.infer\(", r"\.generate\(", r"\.run\(", r"\.evaluate\(",
        r"\.classify\(", r"\.detect\(",
    ],
    "r": [r"predict\(", r"fitted\(", r"fitted.values\("],
    "javascript": [r"\.predict\(", r"\.execute\(", r"\.run\("],
    "java": [r"\.predict\(", r"\.score\(", r"\.classify\("],
}
DETECTOR_TRAINING = {
    "python": [
        r"\.fit\(", r"\.train\(", r"\.learn\(", r"\.compile\(", r"\.backward\(",
        r"\.step\(", r"\.optimize\(", r"\.update\(",
    ],
    "r": [r"train\(", r"fit\(", r"caret::train\("],
}

PIPELINE_GLOBS = [
    "*pipeline*", "*etl*", "*extract*", "*transform*", "*load*", "*feature*",
    "*preprocess*", "*postprocess*", "*train*", "*evaluate*", "*inference*",
    "*prediction*", "*model_serving*", "dags/", "*airflow*", "*beam*", "*spark*",
    "*flink*", "*kafka*",
]
SCANNER_PIPELINE_GLOBS = [
    "*pipeline*", "*etl*", "*extract*", "*transform*", "*load*", "*feature*",
    "*preprocess*", "*postprocess*", "*train*", "*evaluate*", "*inference*",
    "*prediction*", "*model_serving*", "*dags*", "*airflow*", "*spark*", "*flink*",
    "*beam*", "*kafka*",
]
PIPELINE_CODE = [".py", ".sql", ".ipynb", ".sh", ".java", ".scala"]
SCANNER_PIPELINE_CODE = PIPELINE_CODE + [".r"]

# service language -> framework -> endpoint patterns; a two-group pattern
# captures (method, path), a one-group pattern captures the path of a GET
ENDPOINT_PATTERNS = {
    "Python": {
        "flask": [
            r"""@app\.route\(['"]([^'"]+)['"]""",
            r"""@app\.(get|post|put|delete)\(['"]([^'"]+)['"]""",
        ],
        "fastapi": [
            r"""@app\.(get|post|put|delete)\(['"]([^'"]+)['"]""",
            r"""@router\.(get|post|put|delete)\(['"]([^'"]+)['"]""",
        ],
        "django": [
            r"""path\(['"]([^'"]+)['"]""",
            r"""re_path\(['"]([^'"]+)['"]""",
        ],
    },
    "JavaScript/Node.js": {
        "express": [
            r"""app\.(get|post|put|delete)\(['"]([^'"]+)['"]""",
            r"""router\.(get|post|put|delete)\(['"]([^'"]+)['"]""",
        ],
        "fastify": [r"""fastify\.(get|post|put|delete)\(['"]([^'"]+)['"]"""],
        "koa": [r"""router\.(get|post|put|delete)\(['"]([^'"]+)['"]"""],
    },
    "Java": {
        "spring": [
            r"""@RequestMapping\(['"]([^'"]+)['"]""",
            r"""@GetMapping\(['"]([^'"]+)['"]""",
            r"""@PostMapping\(['"]([^'"]+)['"]""",
        ],
        "jax-rs": [
            r"""@Path\(['"]([^'"]+)['"]""",
            r"""@GET\s*@Path\(['"]([^'"]+)['"]""",
        ],
    },
    "Go": {
        "gin": [
            r"""r\.(GET|POST|PUT|DELETE)\(['"]([^'"]+)['"]""",
            r"""router\.(GET|POST|PUT|DELETE)\(['"]([^'"]+)['"]""",
        ],
        "echo": [r"""e\.(GET|POST|PUT|DELETE)\(['"]([^'"]+)['"]"""],
    },
    "Ruby": {
        "rails": [
            r"""get\s+['"]([^'"]+)['"]""",
            r"""post\s+['"]([^'"]+)['"]""",
            r"""resources\s+:[\w]+""",
        ],
    },
    "PHP": {
        "laravel": [
            r"""Route::(get|post|put|delete)\(['"]([^'"]+)['"]""",
            r"""Route::resource\(['"]([^'"]+)['"]""",
        ],
    },
}
ENDPOINT_CODE = [".py", ".js", ".java", ".go", ".rb", ".php"]

MANIFEST_NAMES = ["package.json", "requirements.txt", "pom.xml", "go.mod"]
MANIFEST_FRAMEWORKS = {
    "django": ["django"],
    "flask": ["flask"],
    "fastapi": ["fastapi"],
    "react": ["react", "react-dom"],
    "vue": ["vue"],
    "angular": ["angular", "@angular/core"],
    "spring": ["spring-boot", "spring-core"],
    "express": ["express"],
    "tensorflow": ["tensorflow"],
    "pytorch": ["torch"],
    "sklearn": ["scikit-learn"],
}

# code patterns per framework, matched without regard to case
CODE_FRAMEWORKS = {
    "flask": [r"from flask import", r"import flask", r"Flask\("],
    "django": [r"django\.", r"from django", r"DJANGO_"],
    "fastapi": [r"from fastapi", r"import fastapi", r"FastAPI\("],
    "express": [r"""require\(['"]express['"]\)""", r"import express"],
    "react": [r"import React", r"from 'react'", r"React\."],
    "vue": [r"import Vue", r"new Vue\("],
    "angular": [r"@angular", r"Component\(\{", r"NgModule\("],
    "spring": [r"@SpringBoot", r"@Controller", r"@RestController"],
    "tensorflow": [r"import tensorflow", r"tf\.", r"keras\."],
    "pytorch": [r"import torch", r"torch\.", r"nn\.Module"],
    "sklearn": [r"import sklearn", r"from sklearn", r"joblib\."],
    "keras": [r"import keras", r"keras\.", r"tf\.keras"],
    "junit": [r"import org.junit", r"@Test"],
    "pytest": [r"import pytest", r"@pytest\."],
    "rspec": [r"require 'rspec'", r"RSpec\."],
}
CODE_FRAMEWORK_CODE = [".py", ".js", ".java", ".rb", ".php", ".go"]

# framework -> (category, code patterns, path fragments, dependency names)
FRAMEWORKS = {
    "Flask": (
        "Web Framework",
        [r"from flask import", r"import flask", r"Flask\("], ["flask"], ["flask"],
    ),
    "Django": (
        "Web Framework",
        [r"django\.", r"from django", r"DJANGO_"],
        ["manage.py", "settings.py", "urls.py"], ["django"],
    ),
    "FastAPI": (
        "Web Framework",
        [r"from fastapi", r"import fastapi", r"FastAPI\("], [], ["fastapi"],
    ),
    "Express": (
        "Web Framework",
        [r"""require\(['"]express['"]\)""", r"import express"],
        ["app.js", "server.js", "index.js"], ["express"],
    ),
    "React": (
        "Frontend Framework",
        [r"import React", r"from 'react'", r"React\."],
        ["App.js", "App.tsx", "index.js"], ["react", "react-dom"],
    ),
    "Vue": (
        "Frontend Framework",
        [r"import Vue", r"new Vue\(", r"Vue\.component"],
        ["vue.config.js", "main.js"], ["vue"],
    ),
    "Angular": (
        "Frontend Framework",
        [r"@angular", r"Component\(\{", r"NgModule\("],
        ["angular.json", "app.module.ts"], ["@angular/core"],
    ),
    "Spring": (
        "Web Framework",
        [r"@SpringBoot", r"@Controller", r"@RestController"],
        ["application.properties", "pom.xml"], ["spring-boot", "spring-core"],
    ),
    "TensorFlow": (
        "ML Framework",
        [r"import tensorflow", r"tf\.", r"tensorflow\."],
        ["model.h5", "saved_model.pb"], ["tensorflow", "tf"],
    ),
    "PyTorch": (
        "ML Framework",
        [r"import torch", r"torch\.", r"nn\.Module"], [".pt", ".pth"], ["torch", "pytorch"],
    ),
    "Scikit-learn": (
        "ML Framework",
        [r"import sklearn", r"from sklearn", r"sklearn\."],
        [".pkl", ".joblib"], ["scikit-learn", "sklearn"],
    ),
    "Keras": (
        "ML Framework",
        [r"import keras", r"keras\.", r"tf\.keras"], [".h5", ".keras"], ["keras"],
    ),
    "JAX": ("ML Framework", [r"import jax", r"jax\.", r"jaxlib"], [], ["jax"]),
    "ONNX": (
        "ML Framework",
        [r"import onnx", r"onnx\.", r"onnxruntime"], [".onnx"], ["onnx", "onnxruntime"],
    ),
    "XGBoost": ("ML Framework", [r"import xgboost", r"xgb\.", r"XGB"], [], ["xgboost"]),
    "LightGBM": (
        "ML Framework", [r"import lightgbm", r"lgb\.", r"LightGBM"], [], ["lightgbm"],
    ),
    "Pandas": ("Data Processing", [r"import pandas", r"pd\.", r"DataFrame"], [], ["pandas"]),
    "NumPy": ("Data Processing", [r"import numpy", r"np\.", r"numpy\."], [], ["numpy"]),
    "Spark": (
        "Data Processing", [r"import pyspark", r"spark\.", r"SparkSession"], [], ["pyspark"],
    ),
    "JUnit": ("Testing", [r"import org.junit", r"@Test"], [], ["junit"]),
    "pytest": (
        "Testing",
        [r"import pytest", r"@pytest\.", r"pytest\."],
        ["test_*.py", "*_test.py"], ["pytest"],
    ),
    "Mocha": (
        "Testing",
        [r"describe\(", r"it\(", r"beforeEach\("], ["test/"], ["mocha", "chai"],
    ),
    "Jest": (
        "Testing", [r"test\(", r"expect\(", r"jest\."], ["jest.config.js"], ["jest"],
    ),
    "Webpack": ("Build Tool", [], ["webpack.config.js"], ["webpack"]),
    "Babel": ("Build Tool", [], [".babelrc", "babel.config.js"], ["@babel/core"]),
    "Maven": ("Build Tool", [], ["pom.xml"], []),
    "Gradle": ("Build Tool", [], ["build.gradle", "settings.gradle"], []),
    "SQLAlchemy": (
        "ORM", [r"import sqlalchemy", r"sa\.", r"declarative_base"], [], ["sqlalchemy"],
    ),
    "Mongoose": (
        "ORM", [r"""require\(['"]mongoose['"]\)""", r"import mongoose"], [], ["mongoose"],
    ),
    "Hibernate": (
        "ORM",
        [r"import org.hibernate", r"@Entity", r"@Table"],
        ["hibernate.cfg.xml"], ["hibernate"],
    ),
    "MLflow": (
        "MLOps",
        [r"import mlflow", r"mlflow\.", r"MlflowClient"], ["mlruns/"], ["mlflow"],
    ),
    "Kubeflow": ("MLOps", [r"import kubeflow", r"kfp\."], ["pipeline.yaml"], ["kubeflow"]),
    "BentoML": ("MLOps", [r"import bentoml", r"bentoml\."], ["bentofile.yaml"], ["bentoml"]),
}
FRAMEWORK_CODE = [".py", ".js", ".java", ".rb", ".php", ".go", ".ts"]

# smell rules
LOADING_PATTERNS = [
    r"joblib\.load\(", r"pickle\.load\(", r"torch\.load\(", r"load_model\(",
    r"keras\.models\.load_model\(", r"tf\.keras\.models\.load_model\(", r"onnx\.load\(",
    r"model\.load_weights\(", r"from_pretrained\(", r"pmml\.load\(",
    r"mlflow\.pyfunc\.load_model\(", r"bentoml\.load\(", r"load\(", r"readRDS\(",
    r"keras::load_model_hdf5\(", r"joblib::load\(", r"pickle::load\(", r"torch::load\(",
]
PREDICTION_PATTERNS = DETECTOR_PREDICTION["python"]
PREDICTION_GATE = ["sklearn", "tensorflow", "torch"]
MODEL_CALL_CODE = [".py", ".js", ".java", ".r", ".ipynb"]
GLUE_PATTERNS = {
    "conversions": [
        r"\.to_json\(", r"\.to_csv\(", r"\.to_dict\(", r"\.to_numpy\(", r"\.to_tensor\(",
        r"\.to_list\(", r"\.to_frame\(", r"json\.loads\(", r"json\.dumps\(",
        r"ast\.literal_eval\(", r"pd\.DataFrame\(", r"np\.array\(", r"torch\.tensor\(",
        r"tf\.convert_to_tensor\(", r"pd\.read_csv\(", r"pd\.read_json\(",
    ],
    "reshaping": [
        r"\.reshape\(", r"\.transpose\(", r"\.flatten\(", r"\.squeeze\(",
        r"\.unsqueeze\(", r"\.permute\(", r"\.view\(", r"\.resize\(", r"\.expand\(",
    ],
    "normalization": [
        r"\.normalize\(", r"\.standardize\(", r"\.scale\(", r"MinMaxScaler\(",
        r"StandardScaler\(", r"RobustScaler\(", r"normalize\(", r"preprocessing\.",
    ],
}
GLUE_CODE = [".py", ".js", ".java", ".r"]
CONSUMER_CODE = [".py", ".js", ".java"]
SCHEDULE_WORDS = [
    "schedule", "cron", "every_day", "every_week", "timedelta", "sleep", "periodic",
]
TRIGGER_WORDS = [
    "trigger", "webhook", "event", "listener", "on_", "when_", "if condition",
]
STORAGE_WORDS = ["insert", "update", "save", "store"]
DB_READ_WORDS = ["select", "query", "read"]
README_PATHS = ["README.md", "README.txt", "docs/README.md"]

BUG_KEYWORDS = ["fix", "bug", "error", "issue", "hotfix", "patch", "resolve"]

CONFIG_EXTENSIONS = [".yml", ".yaml", ".json", ".toml", ".ini", ".cfg", ".conf", ".properties"]
DOCKER_FILES = ["Dockerfile", "docker-compose.yml", "docker-compose.yaml"]
LINE_COUNT_CODE = [".py", ".js", ".java", ".go", ".rb", ".php", ".r"]
ROOT_MARKERS = ["src", "lib", "package.json", "requirements.txt", "pom.xml"]
SCANNER_ROOT_MARKERS = ROOT_MARKERS + ["Dockerfile"]

ML_TOPICS = [
    "machine-learning", "deep-learning", "tensorflow", "pytorch", "mlops", "llm",
    "generative-ai",
]
MICROSERVICE_TOPICS = [
    "microservices", "microservice", "service-mesh", "kubernetes", "docker", "istio",
]

MES_WEIGHTS = {
    "direct_calls": 0.25,
    "shared_features": 0.20,
    "pipeline_complexity": 0.15,
    "retrain_frequency": 0.20,
    "impact_radius": 0.10,
    "feedback_loop": 0.10,
}
