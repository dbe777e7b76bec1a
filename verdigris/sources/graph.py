"""The typed node and edge tables, projected from the star-schema test tables.

Each table is a DataFrame built on first use; nothing is collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from verdigris.lineage import cut

#: Edges that one task makes distinct.
EDGES = 1 << 18


class Graph:
    """Tables of one data folder; the columns are those of the edge-list model."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def customers(self) -> DataFrame:
        """Customers with the region that serves as their framework."""
        nation, region = self.table("nation"), self.table("region")
        place = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("r_name").alias("framework"))
        # nation and region are fixed lists of the data model
        return self.table("customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "framework")

    @cached_property
    def rule(self) -> DataFrame:
        status = F.col("o_orderstatus")
        priority = F.col("o_orderpriority")
        return self.table("orders").join(self.customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("rule_id"),
            "framework",
            ((F.year("o_orderdate") - 1990) * 1000000 + F.month("o_orderdate") * 1000).cast("long").alias("sortable"),
            F.when(status == "F", "actionable").when(status == "O", "incomplete").alias("classification"),
            F.when(priority == "1-URGENT", "critical").when(priority == "2-HIGH", "high").when(priority == "3-MEDIUM", "medium").when(priority == "5-LOW", "low").alias("severity"),
            F.when(F.col("o_orderkey") % 3 == 0, "api").when(F.col("o_orderkey") % 3 == 1, "config").otherwise("general").alias("scope"),
            F.when(F.col("o_orderkey") % 4 == 0, "breaking").when(F.col("o_orderkey") % 4 == 1, "mandatory_migration").when(F.col("o_orderkey") % 4 == 2, "behavioral").otherwise("deprecation").alias("rule_type"),
        )

    @cached_property
    def version(self) -> DataFrame:
        s = F.col("sortable")
        return self.rule.select("framework", "sortable").distinct().withColumn(
            "version", F.concat_ws(".", F.floor(s / 1000000).cast("string"), F.floor(s / 1000 % 1000).cast("string"), F.lit("0"))
        )

    @cached_property
    def part_entity(self) -> DataFrame:
        brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
        kind = F.lower("p_type")
        words = F.split("p_name", " ")
        one, two = F.get(words, F.lit(0)), F.get(words, F.lit(1))
        which = F.col("p_partkey") % 3
        return self.table("part").select(
            "p_partkey", "p_brand", "p_type", "p_size", "p_name", "p_retailprice",
            F.when(which == 0, "Class").when(which == 1, "ApplicationProperty").otherwise("Dependency").alias("kind"),
            F.when(which == 0, F.concat(F.lit("org."), brand, F.lit("."), kind, F.lit("."), F.initcap(one), F.initcap(two)))
            .when(which == 1, F.concat_ws(".", brand, kind, one, two))
            .otherwise(F.concat(F.lit("org."), brand, F.lit(":"), one, F.lit("-"), two))
            .alias("name"),
        )

    @cached_property
    def affects(self) -> DataFrame:
        """(rule_id, kind, name), one row per edge."""
        lines = self.table("lineitem")
        # dealt out by rule first: nearly all edges differ, and a task holds its distinct ones
        return self._edges(lines).repartition(max(1, -(-lines.count() // EDGES)), "rule_id").distinct()

    def _edges(self, lines: DataFrame) -> DataFrame:
        return lines.join(self.part_entity, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("rule_id"), "kind", "name")

    def _lines_of(self, rules: DataFrame) -> DataFrame:
        return self.table("lineitem").join(rules.select(F.col("rule_id").alias("l_orderkey")), "l_orderkey", "left_semi")

    def affects_of(self, rules: DataFrame) -> DataFrame:
        """``affects`` of some rules, read once: lines of others go before they meet their names."""
        return cut(self._edges(self._lines_of(rules)).distinct())

    def step_of(self, rules: DataFrame) -> DataFrame:
        """``step`` of some rules, read once."""
        return cut(self._steps(self._lines_of(rules)))

    @cached_property
    def role_edge(self) -> DataFrame:
        """(rule_id, kind, name, role)."""
        role = F.when(F.col("l_returnflag") == "R", "removed").when(F.col("l_linestatus") == "F", "replacement").otherwise("mentioned")
        return (
            self.table("lineitem")
            .join(self.part_entity, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_orderkey").alias("rule_id"), "kind", "name", role.alias("role"))
            .distinct()
        )

    @cached_property
    def scan_names(self) -> DataFrame:
        """Flat scanned names: entities of every 17th part, and simple names of every 101st class."""
        p = self.part_entity
        simple = p.where((F.col("p_partkey") % 101 == 0) & (F.col("kind") == "Class")).select(F.element_at(F.split("name", r"\."), -1).alias("name"))
        return p.where(F.col("p_partkey") % 17 == 0).select("name").union(simple).distinct()

    @cached_property
    def step(self) -> DataFrame:
        return self._steps(self.table("lineitem"))

    def _steps(self, lines: DataFrame) -> DataFrame:
        w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
        first = lines.withColumn("rn", F.row_number().over(w)).where("rn = 1")
        n = F.col("l_partkey") % 5
        return first.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("step_id"),
            F.col("l_orderkey").alias("rule_id"),
            F.col("l_linenumber").alias("step_index"),
            F.when(F.col("l_returnflag") == "A", "mechanical").when(F.col("l_returnflag") == "N", "moderate").otherwise("architectural").alias("effort"),
            (F.col("l_linestatus") == "F").alias("automatable"),
            F.when(n == 0, F.concat(F.lit("Replace part"), F.col("l_partkey").cast("string"), F.lit(" with part"), F.col("l_suppkey").cast("string")))
            .when(n == 1, F.concat(F.lit("Rename key"), F.col("l_partkey").cast("string"), F.lit(" to key"), F.col("l_suppkey").cast("string")))
            .when(n == 2, F.lit("Review the configuration by hand"))
            .when(n == 3, F.lit("old() -> new()"))
            .otherwise(F.lit("Check release notes"))
            .alias("instruction"),
            F.when(F.col("l_discount") >= 0.05, F.col("l_suppkey")).alias("recipe_id"),
            F.when(F.col("l_discount") >= 0.05, F.col("l_tax") <= 0.04).alias("auto"),
            ((F.col("l_discount") >= 0.05) & (F.col("l_quantity") > 40)).alias("missing_params"),
        )

    @cached_property
    def replaced_by(self) -> DataFrame:
        """(old_part, new_part): the next part of the same brand, type and size."""
        w = Window.partitionBy("p_brand", "p_type", "p_size").orderBy("p_partkey")
        return (
            self.table("part").select(F.col("p_partkey").alias("old_part"), F.lead("p_partkey").over(w).alias("new_part")).where("new_part is not null")
        )

    @cached_property
    def context(self) -> DataFrame:
        k = F.col("c_custkey")
        low = (2006000 + (k % 5) * 1000000).cast("long")
        return self.customers.select(
            k.alias("context_id"), "framework", low.alias("from_sortable"), (low + 2000000).alias("to_sortable"),
            F.when(k % 7 == 0, "complete").otherwise("in-progress").alias("status"),
        )

    @cached_property
    def outcome_event(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            "event_id", "ts", F.col("user_id").alias("context_id"),
            F.get_json_object("props", "$.k").cast("int").alias("step_key"),
            F.when(kind == "purchase", "completed").when(kind == "click", "skipped").when(kind == "error", "failed").when(kind == "view", "deferred").when(kind == "signup", "excluded").alias("status"),
            "value",
        )

    @cached_property
    def insight(self) -> DataFrame:
        labels = self.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        return self.table("documents").select("doc_id", "text", "lang", "source").join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("insight_id"), F.col("text").alias("statement"), F.col("lang").alias("framework"), "source",
            (F.coalesce("quality", F.lit(0)) == 1).alias("verified"),
        )
