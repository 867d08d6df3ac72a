"""Files on the driver's side: where the data lies, sizes, checksums, logging."""

from __future__ import annotations

import hashlib
import json
import logging
import os
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

X = TypeVar("X")
#: The environment variable and the configuration file that name the data folder.
FOLDER_VARIABLE, CONFIG_FILE = "DATASET_DIR", "dataset.json"
FILES = {"train_s1": "train/source_1.tsv", "train_s2": "train/source_2.tsv", "train_s3": "train/source_3.tsv", "train_gt": "train/ground_truth.tsv"}


def find_files(directory: str | Path, pattern: str = "*.tsv", recursive: bool = False) -> list[Path]:
    root = Path(directory)
    if not root.is_dir():
        raise FileNotFoundError(f"no directory {root}")
    return sorted(root.rglob(pattern) if recursive else root.glob(pattern))


def file_size_mb(path: str | Path) -> float:
    return Path(path).stat().st_size / 2**20


def format_bytes(n: float) -> str:
    """Human-readable size with the number of bytes."""
    value = float(n)
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if value < 1024 or unit == "TB":
            return f"{value:.2f} {unit} ({int(n):,} bytes)"
        value /= 1024
    raise AssertionError


def describe_file(path: str | Path) -> str:
    return f"{Path(path).name} ({file_size_mb(path):.1f} MB)"


def file_md5(path: str | Path, max_bytes: int | None = None) -> str:
    """MD5 of a local file, whole unless limited."""
    digest, left = hashlib.md5(), max_bytes
    with open(path, "rb") as f:
        while part := f.read(1 << 20 if left is None else min(left, 1 << 20)):
            digest.update(part)
            if left is not None:
                left -= len(part)
    return digest.hexdigest()


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, md5)`` of whole files that Spark can open."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"))


def resolve_dataset(root: str | Path | None = None, files: dict[str, str] = FILES) -> dict[str, Path]:
    """Paths of the training files: from the environment, the configuration, or the usual folders."""
    base = Path(root or ".")
    places: list[Path] = []
    if os.environ.get(FOLDER_VARIABLE):
        places.append(Path(os.environ[FOLDER_VARIABLE]))
    if (config := base / CONFIG_FILE).is_file() and (named := json.loads(config.read_text()).get("dataset_dir")):
        places.append(Path(named))
    places += [base / "dataset", base / "data", base]
    for place in places:
        found = {k: place / v for k, v in files.items()}
        if all(p.is_file() for p in found.values()):
            return found
    raise FileNotFoundError("training files not found in " + ", ".join(map(str, places)))


def verify_files(paths: Iterable[str | Path]) -> list[str]:
    """What is wrong with files that should be there and hold something."""
    out = []
    for p in map(Path, paths):
        if not p.is_file():
            out.append(f"missing: {p}")
        elif p.stat().st_size == 0:
            out.append(f"empty: {p}")
    return out


def setup_logging(level: int = logging.INFO, log_file: str | None = None) -> logging.Logger:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if log_file:
        Path(log_file).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(log_file))
    logging.basicConfig(level=level, handlers=handlers, force=True, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    return logging.getLogger("weftlink")


def get_logger(name: str) -> logging.Logger:
    return logging.getLogger(f"weftlink.{name}")


def progress(items: Iterable[X], desc: str = "", every: int = 100_000) -> Iterator[X]:
    """The items, with a log line now and then."""
    log = get_logger("progress")
    for i, item in enumerate(items, 1):
        if i % every == 0:
            log.info("%s: %d", desc, i)
        yield item
