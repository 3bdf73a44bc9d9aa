"""Rule-based profiles, forecasts and report rows per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotmeter.operators.scores import percent


def structure_profile(rows: DataFrame) -> DataFrame:
    many, models = F.col("services_count") > 1, F.col("models_count") > 0
    patterns = F.array(
        F.when(many, F.lit("Microservices architecture detected")),
        F.when(models, F.lit("AI components integrated")),
    )
    return rows.withColumns(
        {
            "patterns": F.filter(patterns, lambda x: x.isNotNull()),
            "architectural_style": F.when(many, "Microservices").otherwise("Monolith"),
            "ai_maturity": F.when(models, "Emerging").otherwise("None"),
            "structure_improvements": F.array(
                F.lit("Consider adding API gateway"), F.lit("Implement service discovery"),
                F.lit("Add distributed tracing"),
            ),
        }
    )


def architecture_profile(rows: DataFrame) -> DataFrame:
    n = F.col("services_count")
    return rows.withColumns(
        {
            "pattern": F.when(n > 1, "Service-based architecture").otherwise("Monolithic"),
            "communication_style": F.lit("hybrid"),
            "bottleneck": F.when(n == 1, "Potential single point of failure").otherwise(
                "None detected"
            ),
        }
    )


def smell_severity(rows: DataFrame) -> DataFrame:
    direct = F.col("direct_count") > 0
    return rows.withColumns(
        {
            "issue_type": F.when(direct, F.lit("direct_model_coupling")),
            "issue_severity": F.when(direct, F.lit("High")),
            "issue_impact": F.when(
                direct, F.lit("Increased maintenance cost and reduced flexibility")
            ),
            "impact_prediction": F.when(
                direct, F.lit("Model changes will require widespread service updates")
            ).otherwise(F.lit("Low impact expected")),
        }
    )


def debt_forecast(rows: DataFrame) -> DataFrame:
    mes, ten = F.col("mes_score"), F.lit(10.0)
    step = F.when(mes > 7, 2.5).when(mes > 4, 1.5).otherwise(0.5)
    return rows.withColumns(
        {
            "predicted_increase": step,
            "six_month_forecast": F.least(ten, mes + step),
            "twelve_month_forecast": F.least(ten, mes + step * 2),
            "intervention_timeline": F.when(mes > 7, "ASAP").when(mes > 4, "Within 3 months")
            .otherwise("Within 6 months"),
            "velocity_impact": F.lit(
                "Development velocity will decrease by 15-20% if not addressed"
            ),
        }
    )


def risk_assessment(rows: DataFrame) -> DataFrame:
    bug, mes = F.col("bug_rate"), F.col("mes_score")
    high, medium = (bug > 0.3) | (mes > 7), (bug > 0.15) | (mes > 4)
    factors = F.array(
        F.struct(
            F.when(bug > 0.2, F.concat(F.lit("High bug rate ("), percent(bug, 1), F.lit(")")))
            .otherwise(F.lit("Low bug rate")).alias("factor"),
            F.when(bug > 0.2, "High").otherwise("Low").alias("severity"),
            F.lit("Implement comprehensive testing strategy").alias("mitigation"),
        ),
        F.struct(
            F.concat(F.lit("Model entanglement (MES: "), mes.cast("string"), F.lit(")")).alias("factor"),
            F.when(mes > 7, "Critical").when(mes > 4, "Medium").otherwise("Low").alias("severity"),
            F.lit("Introduce model serving layer").alias("mitigation"),
        ),
    )
    return rows.withColumns(
        {
            "overall_risk": F.when(high, "High").when(medium, "Medium").otherwise("Low"),
            "criticality_score": F.when(high, 0.8).when(medium, 0.5).otherwise(0.2),
            "assessed_factors": factors,
        }
    )


def first_services(services: DataFrame, n: int = 5) -> DataFrame:
    """The first n services by name and path, as one bounded array per project."""
    w = Window.partitionBy("project_id").orderBy("name", "path")
    return (
        services.select("project_id", "name", "path", "language")
        .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
        .groupBy("project_id")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "name", "language"))).alias("first_services"))
    )


def _component(name, kind, purpose, technologies, duties) -> Column:
    def texts(values):
        return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])

    as_column = [v if isinstance(v, Column) else F.lit(v) for v in (name, kind, purpose)]
    return F.struct(
        as_column[0].alias("name"), as_column[1].alias("type"), as_column[2].alias("purpose"),
        texts(technologies).alias("technologies"), texts(duties).alias("responsibilities"),
    )


def architecture_proposal(rows: DataFrame) -> DataFrame:
    """Needs mes_score, models_count, glue_ratio, direct_count and ``first_services``."""
    mes, models, glue = F.col("mes_score"), F.col("models_count") > 0, F.col("glue_ratio") > 0.2
    services = F.transform(
        F.coalesce(
            F.col("first_services"),
            F.array().cast("array<struct<rn:int,name:string,language:string>>"),
        ),
        lambda s: _component(
            s["name"], "service", F.concat(F.lit("Business logic for "), s["name"]),
            [s["language"]], ["Business logic", "Data processing"],
        ),
    )
    gateway = _component(
        "API Gateway", "gateway", "Route requests and handle authentication",
        ["Kong", "NGINX", "Traefik"], ["Request routing", "Rate limiting", "Authentication"],
    )
    serving = _component(
        "Model Serving Layer", "model_server", "Serve ML models via APIs",
        ["BentoML", "Seldon Core", "KServe"],
        ["Model inference", "Version management", "Load balancing"],
    )
    store = _component(
        "Feature Store", "feature_store", "Centralized feature management",
        ["Feast", "Tecton", "Hopsworks"],
        ["Feature engineering", "Feature serving", "Feature versioning"],
    )
    monitoring = _component(
        "Observability Stack", "monitoring", "Monitor system health and model performance",
        ["Prometheus", "Grafana", "Jaeger"], ["Metrics collection", "Tracing", "Alerting"],
    )

    def present(*items):
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    def flow(a, b, text, protocol):
        return F.struct(
            F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit(text).alias("description"),
            F.lit(protocol).alias("protocol"),
        )

    direct = F.col("direct_count") > 0
    serving_first = F.lit("Introduce model serving layer to eliminate direct model calls")
    library = F.lit("Implement shared feature engineering library")
    base = [
        F.lit("Decouple AI models from business logic"),
        F.lit("Implement model versioning and canary deployments"),
        F.lit("Add comprehensive monitoring and observability"),
        F.lit("Standardize data transformation pipelines"),
    ]
    # the library always takes the second place of the list
    improvements = present(
        F.when(direct, serving_first).otherwise(base[0]),
        F.when(glue, library),
        F.when(direct, base[0]),
        *base[1:],
    )
    steps = F.array(
        F.lit("Audit all model dependencies and usage patterns"),
        F.lit("Design model serving API contracts"),
        F.lit("Implement model serving layer with shadow mode"),
        F.lit("Gradually migrate services to use model APIs"),
        F.lit("Decommission direct model access"),
        F.lit("Set up monitoring and alerting"),
    )
    return rows.withColumns(
        {
            "architecture_name": F.when(mes > 7, "Full Isolation Architecture")
            .when(mes > 4, "Gradual Decoupling Architecture")
            .otherwise("Well-Integrated Architecture"),
            "architecture_description": F.when(
                mes > 7,
                "Complete separation of AI components with dedicated model serving layer",
            ).when(
                mes > 4,
                "Phased approach to isolate AI components while maintaining existing functionality",
            ).otherwise("Optimized existing architecture with minor improvements"),
            "components": F.concat(
                F.array(gateway), services,
                present(F.when(models, serving), F.when(glue, store), monitoring),
            ),
            "data_flow": present(
                flow("API Gateway", "Service Layer", "API requests", "REST/gRPC"),
                F.when(
                    models,
                    flow("Service Layer", "Model Serving Layer", "Inference requests", "gRPC"),
                ),
            ),
            "improvements": improvements,
            "migration_steps": steps,
            "estimated_effort": F.when(mes > 7, "High").when(mes > 4, "Medium").otherwise("Low"),
            "expected_mes_reduction": F.bround(
                F.when(mes > 0, F.least(F.lit(5.0), mes * 0.6)).otherwise(F.lit(3.0)), 1
            ),
        }
    )


def insight_rows(rows: DataFrame) -> DataFrame:
    """One row per finding; a default row when nothing was found."""
    c = F.col

    def insight(condition, title, finding, impact, advice):
        return F.when(
            condition,
            F.struct(
                F.lit(title).alias("title"), finding.alias("finding"),
                F.lit(impact).alias("impact"), F.lit(advice).alias("recommendation"),
            ),
        )

    found = F.filter(
        F.array(
            insight(
                c("direct_count") > 0, "Architectural Smell: Direct Model Coupling",
                F.concat(F.lit("Detection of "), c("direct_count").cast("string"),
                         F.lit(" services with direct model dependencies")),
                "High - Each model change requires coordinated updates across multiple services",
                "Implement dedicated model serving layer with versioned APIs",
            ),
            insight(
                c("hidden_count") > 0, "Architectural Smell: Hidden Model Consumers",
                F.concat(F.lit("Identification of "), c("hidden_count").cast("string"),
                         F.lit(" undocumented model consumers")),
                "Critical - Breaking changes may affect unknown downstream systems",
                "Establish model registry and consumer documentation portal",
            ),
            insight(
                c("glue_ratio") > 0.15, "Architectural Smell: Excessive Glue Code",
                F.concat(F.lit("Glue code constitutes "), percent(c("glue_ratio"), 1),
                         F.lit(" of codebase")),
                "Medium - Increased maintenance cost and reduced developer productivity",
                "Standardize data transformation pipelines with reusable components",
            ),
            insight(
                c("loops_count") > 0, "Architectural Smell: Feedback Loops",
                F.concat(F.lit("Detection of "), c("loops_count").cast("string"),
                         F.lit(" potential feedback loops between prediction and training")),
                "Critical - May cause model degradation and system instability",
                "Implement shadow deployment and A/B testing for model validation",
            ),
        ),
        lambda x: x.isNotNull(),
    )
    default = F.array(
        F.struct(
            F.lit("Architectural Assessment").alias("title"),
            F.lit("Well-structured AI integration with minimal technical debt").alias("finding"),
            F.lit("Low - System maintainability is within acceptable parameters").alias("impact"),
            F.lit("Continue monitoring and apply preventative patterns").alias("recommendation"),
        )
    )
    return rows.select("project_id", F.inline(F.when(F.size(found) > 0, found).otherwise(default)))


def summary_tables(rows: DataFrame) -> DataFrame:
    """(section, metric, value) rows of the report's tables."""
    c = F.col

    def whole(name):
        return c(name).cast("string")

    def fixed(value, digits=2):
        return F.format_string(f"%.{digits}f", F.bround(value, digits))

    components = [
        "direct_calls", "shared_features", "pipeline_complexity", "retrain_frequency",
        "impact_radius", "feedback_loop",
    ]
    table = [
        ("findings", "Model Entanglement Score",
         F.concat(fixed(c("mes_score")), F.lit("/10 - "), c("mes_level"))),
        ("findings", "Bug Rate Impact", F.concat(percent(c("bug_rate"), 1), F.lit(" of commits are bug fixes"))),
        ("tier1", "Total Services Detected", whole("services_count")),
        ("tier1", "Total ML Models Flagged", whole("models_count")),
        ("tier1", "Code Files Scanned", whole("files_count")),
        ("tier2", "API Endpoints", whole("endpoint_count")),
        ("tier2", "External Dependencies", whole("dependency_count")),
        ("tier2", "Architecture Style",
         F.when(c("services_count") > 1, "Microservices").otherwise("Monolith")),
        ("tier3", "Direct Model Calls", F.concat(whole("direct_count"), F.lit(" instances"))),
        ("tier3", "Glue Code Ratio", percent(c("glue_ratio"), 1)),
        ("tier3", "Hidden Consumers", F.concat(whole("hidden_count"), F.lit(" detected"))),
        *[("tier4", k.replace("_", " ").title(), fixed(c(k))) for k in components],
        ("tier5", "Commits", whole("commit_count")),
        ("tier5", "Bug-Fix Ratio", percent(c("bug_rate"), 1)),
        ("tier5", "Change Impact Radius", fixed(c("avg_change_impact"))),
        ("tier6", "Analysis Accuracy", F.concat(fixed(c("accuracy_rate"), 1), F.lit("%"))),
        ("tier6", "Degradation Ratio", F.concat(
            F.when(c("degradation_ratio") == float("inf"), F.lit("inf"))
            .otherwise(fixed(c("degradation_ratio"))), F.lit("x"))),
        ("tier6", "Hypothesis Confirmed", F.when(c("hypothesis_confirmed"), "Yes").otherwise("No")),
        ("outlook", "Target MES", fixed(F.greatest(F.lit(0.0), c("mes_score") - 4))),
        ("outlook", "Confidence Band",
         F.when(c("accuracy_rate") >= 90, "HIGH CONFIDENCE")
         .when(c("accuracy_rate") >= 70, "RELIABLE ANALYSIS").otherwise("LOW CONFIDENCE")),
    ]
    cells = [
        F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), v.alias("value"))
        for s, m, v in table
    ]
    return rows.select("project_id", F.inline(F.array(*cells)))
