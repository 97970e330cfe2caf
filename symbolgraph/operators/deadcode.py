"""Public methods that nothing reaches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolgraph.operators.hierarchy import closure

# Action methods of controllers, methods that frameworks call by the ending of a class or its folder, folders of
# entities, and the switches of the ladder.
ACTIONS = ("index", "show", "store", "create", "edit", "update", "destroy", "handle")
FRAMEWORK = (
    (("Request",), ("/requests/",), ("rules", "messages", "attributes", "authorize")),
    (("ServiceProvider",), (), ("boot", "register")),
    (("Command", "Job", "Listener", "Middleware"), ("/commands/", "/jobs/", "/listeners/", "/middleware/"), ("handle",)),
)
ENTITIES = ("/entity/", "/entities/", "/dto/", "/dtos/", "/model/", "/models/")
SWITCHES = ("constructors", "base_classes", "magic", "tests", "interfaces", "controller_actions", "framework", "accessors", "abstract")


def skip_reason(off: tuple[str, ...] = ()) -> Column:
    """Why a method isn't a candidate: the first reason that holds, without the switches that are off."""
    parent, file, name = F.coalesce("parent", F.lit("")), F.coalesce("file", F.lit("")), F.col("name")
    low_file, low_name, short = F.lower(file), F.lower(name), F.substring_index(parent, "\\", -1)
    any_of = lambda cs: reduce(Column.__or__, cs, F.lit(False))
    framework = any_of((any_of([parent.endswith(e) for e in ends] + [low_file.contains(f) for f in folders])) & low_name.isin(*names) for ends, folders, names in FRAMEWORK)
    ladder = (
        ("constructors", "constructor", name == "__construct"),
        ("base_classes", "base_class", short.rlike("^(Base|Abstract)[A-Za-z0-9_]") | short.endswith("Base") | low_file.contains("/base/") | low_file.contains("/abstract/") | low_file.rlike(r"/base[a-z0-9_]*\.php$")),
        ("magic", "magic_method", low_name.startswith("__")),
        ("tests", "test_file", low_file.contains("/test/") | low_file.contains("/tests/")),
        ("interfaces", "interface_method", F.col("parent_type") == "interface"),
        ("controller_actions", "controller_action", (parent.contains("Controller") | file.contains("/Controllers/") | file.contains("/Controller/")) & low_name.isin(*ACTIONS)),
        ("framework", "framework_method", framework),
        ("accessors", "entity_accessor", name.rlike("^(get|set|is|has)[A-Z]") & any_of(low_file.contains(x) for x in ENTITIES)),
        ("abstract", "abstract_implementation", F.coalesce("implements", F.lit(False))),
    )
    return F.coalesce(*(F.when(holds, reason) for switch, reason, holds in ladder if switch not in off), F.lit(None).cast("string"))


def methods(nodes: DataFrame, edges: DataFrame, off: tuple[str, ...] = ()) -> DataFrame:
    """Every public method with its incoming counts and skip_reason."""
    public = nodes.where("type = 'method' and visibility = 'public'").select("id", "name", "parent", "file", F.coalesce("is_abstract", F.lit(False)).alias("is_abstract"))
    parents = nodes.select(F.col("id").alias("parent"), F.col("type").alias("parent_type"))
    count = lambda p: F.count(F.when(p, 1))
    got = edges.groupBy(F.col("to_id").alias("id")).agg(
        count(F.col("type") == "CALLS").alias("calls"),
        count(F.col("type") == "ROUTES_TO").alias("routes"),
        count(F.col("type").isin("BLADE_CALLS", "BLADE_USES_ACTION", "BLADE_REFERENCES_SYMBOL")).alias("views"),
    )
    abstract = nodes.where("type = 'method' and is_abstract").select(F.col("parent").alias("ancestor"), "name")
    up = closure(edges).select(F.col("child").alias("parent"), "ancestor").unionByName(nodes.where("type = 'class'").select(F.col("id").alias("parent"), F.col("id").alias("ancestor")))
    implements = up.join(abstract, "ancestor").select("parent", "name").distinct().withColumn("implements", F.lit(True))
    out = public.join(parents, "parent", "left").join(got, "id", "left").join(implements, ["parent", "name"], "left").na.fill(0, ["calls", "routes", "views"])
    return out.withColumn("skip_reason", skip_reason(off))


def dead(nodes: DataFrame, edges: DataFrame, off: tuple[str, ...] = ()) -> DataFrame:
    found = methods(nodes, edges, off).where("skip_reason is null and calls + routes + views = 0")
    like = F.coalesce(F.col("parent").contains("Controller"), F.lit(False)) | F.coalesce(F.col("file").contains("/Controllers/") | F.col("file").contains("/Controller/"), F.lit(False))
    return found.select("id", "parent", "file", F.when(like, "medium").otherwise("high").alias("confidence"))
