"""The library's classes over the DataFrame operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.functions.scalars import content_hash, structure_hash
from larkspar.operators import callgraph, catalog, mermaid, review, similarity
from larkspar.operators.embed import Embedder, with_embeddings
from larkspar.sources.symbols import at_least_lines


@dataclass(frozen=True)
class Scanner:
    """Pairs of similar units, brute force."""

    threshold: float = 0.85
    min_lines: int = 3

    def with_threshold(self, threshold: float) -> Scanner:
        return replace(self, threshold=threshold)

    def with_min_lines(self, n: int) -> Scanner:
        return replace(self, min_lines=n)

    def index_project(self, raw_units: DataFrame) -> DataFrame:
        return at_least_lines(raw_units, self.min_lines)

    def scan_similarities(self, units: DataFrame) -> DataFrame:
        """(unit_a, unit_b, similarity), best first; unit_a stands before unit_b in the order of pos."""
        got = similarity.self_join(units.select(F.struct("pos", "qualified_name").alias("id"), F.col("embedding").alias("v")), self.threshold)
        return got.select(F.col("a.qualified_name").alias("unit_a"), F.col("b.qualified_name").alias("unit_b"), "similarity").orderBy(F.desc("similarity"), "unit_a", "unit_b")


class Store:
    """The catalog with its searches and commands."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.db = spark, catalog.Catalog(spark, root)

    @property
    def projects(self) -> DataFrame:
        return self.db.read("projects")

    @property
    def units(self) -> DataFrame:
        return self.db.read("code_units")

    @property
    def pairs(self) -> DataFrame:
        return self.db.read("similar_pairs")

    @property
    def groups(self) -> DataFrame:
        return self.db.read("similarity_groups")

    def project_id(self, name: str, root_path: str, language: str) -> int:
        wanted = self.spark.createDataFrame([(name, root_path, language)], "name string, root_path string, language string")
        if not catalog.project_by_path(self.projects, root_path).limit(1).count():
            self.db.replace("projects", catalog.add_projects(self.projects, wanted))
        return catalog.project_by_path(self.projects, root_path).first()["id"]

    def index(self, name: str, root_path: str, language: str, raw_units: DataFrame, embedder: Embedder, min_lines: int = 3) -> int:
        """Hashes, embeds (unless known) and stores a project's functions; returns how many. Units whose embedding fails are left out. Without units the time of indexing stays."""
        project = self.project_id(name, root_path, language)
        rows = at_least_lines(raw_units, min_lines).select("qualified_name", F.lit(project).cast("long").alias("project_id"), "file_path", "kind", "range_start", "range_end", "body", content_hash("body").alias("content_hash"), structure_hash("body").alias("structure_hash"))
        if not rows.limit(1).count():
            return 0
        rows = with_embeddings(rows, self.units, embedder).where("embedding is not null").drop("body").withColumn("group_id", F.lit(None).cast("long"))
        before = self.units
        self.db.replace("code_units", catalog.upsert_units(before, catalog.first_of(rows, ["qualified_name"], ["range_start"]).select(*before.columns)))
        self.db.replace("projects", catalog.touch_project(self.projects, project))
        return self.units.where(F.col("project_id") == project).count()

    def search_similar(self, vectors: DataFrame, k: int, threshold: float | None = None, where=None) -> DataFrame:
        """(q, qualified_name, similarity, and the unit's columns) for vectors (q, v); where narrows the units before the k are chosen."""
        corpus = self.units if where is None else self.units.where(where)
        got = similarity.knn(vectors, corpus.select(F.col("qualified_name").alias("c"), F.col("embedding").alias("v")), k, threshold)
        return got.withColumnRenamed("c", "qualified_name").join(self.units, "qualified_name")

    def search_names(self, vectors: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
        return similarity.knn(vectors, self.units.select(F.col("qualified_name").alias("c"), F.col("embedding").alias("v")), k, threshold).withColumnRenamed("c", "qualified_name")

    def scan(self, threshold: float = 0.85, cross_only: bool = False, project_ids: list[int] | None = None, k: int = 100, approximate: bool = False) -> DataFrame:
        """Finds and stores pairs; returns every stored pair at or above the threshold, of any status and project. Fewer than two units: none are found."""
        asked = catalog.units_of_projects(self.units, project_ids).where("embedding is not null")
        if asked.limit(2).count() < 2:
            return review.joined_pairs(self.pairs.limit(0), self.units)
        found = similarity.scan_pairs(self.units.where("embedding is not null"), threshold, k, asked, cross_only, approximate)
        self.db.replace("similar_pairs", catalog.upsert_pairs(self.pairs, found, "scan"))
        got = review.joined_pairs(self.pairs, self.units, threshold)
        several = project_ids is None or len(project_ids) > 1
        if cross_only and several:
            got = review.across_projects(got, catalog.units_of_projects(self.units, project_ids))
        return similarity.ranked(got)

    def status(self) -> DataFrame:
        return review.project_stats(self.projects, self.units, self.pairs, self.groups)

    def list_pairs(self, threshold: float | None = None, project_id: int | None = None, status: str | None = None, limit: int = 20) -> DataFrame:
        return similarity.ranked(review.joined_pairs(self.pairs, self.units, threshold, project_id, status), limit)

    def ignore(self, a: str, b: str) -> bool:
        pairs, found = review.ignore_pair(self.pairs, self.units, a, b)
        if found:
            self.db.replace("similar_pairs", pairs)
        return found

    def create_group(self, project_id: int, name: str, reason: str | None = None, pattern: str | None = None) -> int:
        groups, new_id = catalog.add_group(self.groups, project_id, name, reason, pattern)
        self.db.replace("similarity_groups", groups)
        return new_id

    def add_to_group(self, group_id: int, names: list[str]) -> list[str]:
        """Puts known units into the group; returns the names that are unknown."""
        known = {r[0] for r in self.units.where(F.col("qualified_name").isin(names)).select("qualified_name").collect()}
        if known:
            self.db.replace("code_units", catalog.assign_group(self.units, sorted(known), group_id))
        return [n for n in names if n not in known]

    def list_groups(self, project_id: int | None = None) -> DataFrame:
        """Groups of a project, or of all in the order of project names."""
        if project_id is not None:
            return catalog.groups_of_project(self.groups, project_id).orderBy("id")
        p = self.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
        return self.groups.join(p, "project_id").orderBy("project_name", "project_id", "id")

    def group_members(self, group_id: int) -> DataFrame:
        return catalog.members(self.units, group_id)


class ArchitectureAnalyzer:
    """Dead code and call trees of a graph."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    @staticmethod
    def of(units: DataFrame, calls: DataFrame) -> ArchitectureAnalyzer:
        return ArchitectureAnalyzer(callgraph.build_nodes(units), calls)

    def find_dead_code(self) -> DataFrame:
        return callgraph.dead_code(self.nodes, self.edges)

    def get_call_tree(self, root: str, incoming: bool = False, max_depth: int = 5) -> DataFrame:
        return callgraph.tree_dfs(self.nodes, self.edges, callgraph.find_function(self.nodes, root), max_depth, incoming)


@dataclass(frozen=True)
class MermaidGenerator:
    max_nodes: int = mermaid.MAX_NODES

    def with_max_nodes(self, n: int) -> MermaidGenerator:
        return replace(self, max_nodes=n)

    def generate_call_graph(self, a: ArchitectureAnalyzer) -> str:
        return mermaid.text(mermaid.call_graph(a.nodes, a.edges, self.max_nodes))

    def generate_module_diagram(self, a: ArchitectureAnalyzer, workspace: str = "") -> str:
        return mermaid.text(mermaid.module_diagram(a.nodes, a.edges, workspace))
