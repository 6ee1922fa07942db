"""What a run report says about the machines."""

from __future__ import annotations

import re
import socket
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

DRIVER_FILES = "/proc/driver/nvidia/gpus"
HOST = "host string, cpu string, gpus string"


def cpu_model(path: str = "/proc/cpuinfo") -> str:
    """The first model name in the file; 'Unknown' without one."""
    try:
        text = Path(path).read_text(errors="replace")
    except OSError:
        return "Unknown"
    named = re.search(r"model name[^:\n]*:[ \t]*(.*)", text)
    return named.group(1).strip() if named else "Unknown"


def gpu_names(root: str = DRIVER_FILES) -> list[str]:
    """Names of the GPUs of this machine, or of those that Spark gave this task; empty without any."""
    names = []
    for f in sorted(Path(root).glob("*/information")):
        named = re.search(r"Model:[ \t]*(.*)", f.read_text(errors="replace"))
        names.append(named.group(1).strip() if named else "Unknown GPU")
    task = TaskContext.get()
    given = task.resources().get("gpu") if task else None
    if not given:
        return names
    own = [int(a) for a in given.addresses if a.isdigit()]
    return [names[i] for i in own if i < len(names)] or [f"GPU {a}" for a in given.addresses]


def machines(spark: SparkSession) -> DataFrame:
    """Hosts that run tasks, with their CPU and GPUs: one row a host, asked on the workers."""
    tasks = spark.sparkContext.defaultParallelism

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame([(socket.gethostname(), cpu_model(), ", ".join(gpu_names()))], columns=["host", "cpu", "gpus"])

    return spark.range(0, tasks, 1, tasks).mapInPandas(ask, HOST).distinct()
