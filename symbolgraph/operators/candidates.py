"""Candidates of tickets from many sources, merged: the first source that has a node decides on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which role of a class's integration goes before which, and what ids and files of each kind look like.
ROLES = {"sqs_consumer": 3, "queue_listener": 2, "queue_job": 1, "artisan_command": 0}
QUEUE_JOB, ARCHIVE = r"(?i)expired|archive|vod|sqs", r"expiredvod|archiverecording|archivecontent|archivecontentpath"
PIPELINE, IMPORT_VIEW = r"import|parser|feed|externalmatch|transform|xml|providercategory", r"(?i)/views/.*/import"
CMS_IMPORT = r"\b(cms|detail page|display in|show in the cms|detail view)\b"
DOMAIN = r"(?i)controller|service|resource|request|resolver|provider"


def first_wins(branches: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """The rows of branches, one for each key: of the first branch that has it, its first by `order`. One shuffle for all
    branches, and each task keeps one row a key before it."""
    every = reduce(DataFrame.unionByName, (b.withColumn("branch", F.lit(k)) for k, b in enumerate(branches)))
    rest = [c for c in every.columns if c not in keys]
    return every.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("branch", order)).alias("x")).select(*keys, "x.*")


def merge_anchors(routes: DataFrame, fields: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ticket, id, score, reason, rank) of anchors (ticket, id, score, reason): the first kind that has a node decides, the
    best score leads; ties by kind and id."""
    found = first_wins([b.withColumn("place", -F.col("score")) for b in (routes, fields, symbols)], ["ticket", "id"], "place")
    order = Window.partitionBy("ticket").orderBy(F.desc("score"), "branch", "id")
    return found.withColumn("rank", F.row_number().over(order)).drop("place", "branch")


def best_role(integrations: DataFrame) -> DataFrame:
    """Of the integrations of a class (ids `integration:class:…`) the one of the best role, the first of these, in the
    place of the class's first."""
    own = integrations.where(F.col("id").startswith("integration:")).withColumn("class", F.get(F.split("id", ":"), F.lit(1))).where("class <> ''")
    role = F.lit(0)
    for name, k in ROLES.items():
        role = F.when(F.col("name") == name, k).otherwise(role)
    rest = [c for c in integrations.columns if c not in ("ticket", "place")]
    best = own.groupBy("ticket", "class").agg(F.min_by(F.struct(*rest), F.struct(-role, F.col("place"))).alias("x"), F.min("place").alias("place"))
    return best.select("ticket", "class", "place", "x.*")


def merge_by_workflow(workflows: DataFrame, methods: DataFrame, integrations: DataFrame, frontend: DataFrame, anchored: DataFrame, generic: Column | None = None) -> DataFrame:
    """(ticket, id, …, rank): the candidates of each ticket in the order that its workflow gives the sources.

    workflows is (ticket, workflow, text); methods, integrations and frontend are (ticket, place, id, type, name, file,
    score), place the order within a source; anchored is (ticket, id), the nodes that a ticket's symbols name, and generic
    says of api methods which go for want of an anchor. A node in several sources counts in the first.
    """
    flow = workflows.select("ticket", "workflow", F.lower("text").rlike(CMS_IMPORT).alias("cms"))
    methods, integrations, frontend = (t.join(flow, "ticket") for t in (methods, integrations, frontend))
    names = F.concat_ws(" ", "id", F.coalesce("file", F.lit("")))
    of = lambda t, workflow: t.where(F.col("workflow") == workflow)
    entry = (F.col("type") == "integration_entrypoint")
    queue = of(integrations, "queue")
    consumers = best_role(queue.where(entry & F.col("name").isin("sqs_consumer", "queue_listener")))
    jobs = best_role(queue.where(entry & (F.col("name") == "queue_job") & F.col("id").rlike(QUEUE_JOB)))
    starts = consumers.select("ticket", F.concat("class", F.lit("::handle")).alias("id"), "place", F.lit(0).alias("of")).unionByName(jobs.select("ticket", F.concat("class", F.lit("::handle")).alias("id"), "place", F.lit(1).alias("of")))
    first = starts.groupBy("ticket", "id").agg(F.min(F.struct("of", "place")).alias("at"))
    handles = of(methods, "queue").drop("place").join(first, ["ticket", "id"]).withColumn("place", F.col("at.of") * F.lit(1 << 40) + F.col("at.place")).drop("at")
    low = F.lower(names)
    view = low.rlike(IMPORT_VIEW)
    api = of(methods, "api") if generic is None else of(methods.join(anchored.withColumn("anchored", F.lit(True)), ["ticket", "id"], "left"), "api").where(~(generic & F.col("anchored").isNull())).drop("anchored")
    branches = [
        consumers.drop("class"), jobs.drop("class"), queue.where((F.col("type") == "config_literal") & F.col("id").rlike("(?i)^config_key:")), of(methods, "queue").where(F.lower("id").rlike(ARCHIVE)), handles,
        of(integrations, "import").where(entry & (F.col("name") == "import_handler")), of(methods, "import").where(low.rlike(PIPELINE) & (~view | F.col("cms"))), of(frontend, "import").where(F.col("cms") & names.rlike(IMPORT_VIEW)),
        of(frontend, "ui").where("type = 'vue_component'"), api.where(names.rlike(DOMAIN)), api, methods.where("workflow <> 'api'"), of(frontend, "ui"),
        of(frontend, "api").join(anchored.select("ticket", "id"), ["ticket", "id"], "left_semi"),
    ]
    columns = ["ticket", "id", "type", "name", "file", "score", "place"]
    found = first_wins([b.select(*columns[:-1], F.col("place").cast("long").alias("place")) for b in branches], ["ticket", "id"], "place")
    order = Window.partitionBy("ticket").orderBy("branch", "place", "id")
    return found.withColumn("rank", F.row_number().over(order)).drop("place")
