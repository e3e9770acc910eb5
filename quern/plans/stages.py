"""The build as a plan of named stages, which can be printed, run and resumed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quern.operators import chunking, regions, splitting
from quern.sources import sinks


@dataclass(frozen=True)
class Config:
    """Sizes in tokens, and evaluation settings."""

    retrieval_chunk: int = 512
    unit_cap: int | None = 180
    region_budget: int = 180
    overhead: int = 3
    top_k: int = 20
    final_budget: int = 1000
    method: str | None = "late_interaction_region"
    distinct: bool = False

    def __post_init__(self) -> None:
        regions.validate_sizes(self.retrieval_chunk, self.region_budget, self.overhead)
        if self.final_budget <= 0:
            raise ValueError("the final budget must be positive")


@dataclass
class Step:
    name: str
    output: str
    needs: list[str] = field(default_factory=list)


def plan(root: str, config: Config) -> list[Step]:
    at = lambda name: f"{root}/{name}"
    steps = [Step("units", at("units")), Step("subchunks", at("subchunks"), ["units"]), Step("chunks", at("chunks"), ["subchunks"]), Step("regions", at("regions"), ["subchunks", "chunks"])]
    return [Step("documents", at("documents")), *steps] if config.distinct else steps


def execute(spark: SparkSession, documents: DataFrame, root: str, config: Config, dry: bool = False) -> list[Step]:
    """Runs the steps whose manifest does not match yet, each writing one table and then its manifest."""
    steps = plan(root, config)
    if dry:
        return steps
    read = lambda name: spark.read.parquet(f"{root}/{name}")

    def documents_() -> DataFrame:
        return documents.join(chunking.distinct_documents(documents).select("doc_id"), "doc_id", "left_semi")

    def units() -> DataFrame:
        rows = splitting.subchunks(read("documents") if config.distinct else documents, merge=True, most=config.unit_cap)
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        by = Window.partitionBy("doc_id").orderBy("ordinal", *(["piece"] if config.unit_cap else []))
        return rows.withColumn("unit", (F.row_number().over(by) - 1).cast("bigint")).drop("ordinal").withColumnRenamed("unit", "ordinal")

    makers = {
        "documents": documents_, "units": units, "subchunks": lambda: chunking.dense_ids(read("units")), "chunks": lambda: chunking.chunks(read("subchunks"), config.retrieval_chunk),
        "regions": lambda: regions.pruned(regions.centred_windows(read("subchunks"), config.region_budget, config.overhead), read("chunks")),
    }
    for step in steps:
        values = {"step": step.name, **{k: v for k, v in vars(config).items() if k in ("retrieval_chunk", "unit_cap", "region_budget", "overhead", "distinct")}}
        found = sinks.read_manifest(spark, f"{step.output}.manifest.json", "quern-table", 1)
        if found == {"format": "quern-table", "format_version": 1, **values}:
            continue
        makers[step.name]().write.mode("overwrite").parquet(step.output)
        sinks.write_manifest(spark, f"{step.output}.manifest.json", "quern-table", 1, values)
    return steps
