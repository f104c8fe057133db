"""What surrounds a run on the driver: its configuration, manifest and lock."""

from __future__ import annotations

import dataclasses
import json
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import fingerprint
from ..sources.corpus import file_digests


@dataclass(frozen=True)
class Retrieval:
    max_results: int = 100
    query_by: str = "hybrid"
    mode: str = "fast"
    alpha: float = 0.5
    graph_context: bool = False
    query_apps: bool = False


@dataclass(frozen=True)
class Context:
    docs: int = 12
    max_chars: int = 240_000
    saved: int = 50
    submitted: int = 10


@dataclass(frozen=True)
class Judge:
    shards: int = 20
    parallelism: int = 5


@dataclass(frozen=True)
class RunConfig:
    """workers and judge change how a run goes, not what it answers; the fingerprint leaves them out."""

    retrieval: Retrieval = field(default_factory=Retrieval)
    context: Context = field(default_factory=Context)
    judge: Judge = field(default_factory=Judge)
    workers: int = 6

    @classmethod
    def load(cls, path: str) -> RunConfig:
        """From a JSON file, or a YAML one if a YAML library is there; what it leaves out has its default."""
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                raw = yaml.safe_load(f) or {}
            else:
                raw = json.load(f)
        parts = {"retrieval": Retrieval, "context": Context, "judge": Judge}
        return cls(**{k: parts[k](**v) if k in parts else v for k, v in raw.items()})

    def fingerprint(self) -> str:
        return fingerprint({k: v for k, v in dataclasses.asdict(self).items() if k not in ("workers", "judge")})


def record_stage(spark: SparkSession, manifest: str, stage: str, config: RunConfig, root: str) -> None:
    """Appends the digests of all files below root to a manifest table (stage, at, config, path, sha256)."""
    rows = file_digests(spark, root)
    rows.select(F.lit(stage).alias("stage"), F.lit(time.time_ns()).alias("at"), F.lit(config.fingerprint()).alias("config"), "path", "sha256").write.mode("append").parquet(manifest)


def manifest_rows(spark: SparkSession, manifest: str) -> DataFrame:
    return spark.read.parquet(manifest)


class Lock:
    """A lock file that only its owner releases; one older than stale seconds is taken over."""

    def __init__(self, path: str, stale: float = 3600.0):
        self.path, self.stale, self.token = path, stale, uuid.uuid4().hex

    def __enter__(self) -> Lock:
        for _ in range(2):
            try:
                handle = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                if time.time() - os.path.getmtime(self.path) < self.stale:
                    raise RuntimeError(f"{self.path} is held by another run") from None
                taken = f"{self.path}.{self.token}"
                os.rename(self.path, taken)
                os.unlink(taken)
                continue
            with os.fdopen(handle, "w") as f:
                f.write(self.token)
            return self
        raise RuntimeError(f"{self.path} was taken meanwhile")

    def __exit__(self, *_) -> None:
        with open(self.path) as f:
            mine = f.read() == self.token
        if mine:
            os.unlink(self.path)
