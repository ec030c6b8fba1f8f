"""Landing of files before Spark reads them: configuration, downloads, listings. Runs on the driver."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lesograf.functions.scalars import raw_url

CHUNK = 8192


def load_config(path: str) -> dict:
    """A JSON file, or a YAML file where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def source_urls(config: dict) -> dict[str, dict[str, str]]:
    """corpus -> split -> URL; a value may be a URL or ``{user, repo, branch, path}``."""
    out: dict[str, dict[str, str]] = {}
    for corpus, splits in config.items():
        out[corpus] = {k: v if isinstance(v, str) else raw_url(v["user"], v["repo"], v.get("branch", "master"), v["path"]) for k, v in splits.items()}
    return out


def download(url: str, target: str, force: bool = False, tries: int = 3, timeout: float = 60.0, pause: float = 1.0) -> str:
    """The file of ``url`` at ``target``; one that is there stays unless forced. A connection that fails
    is tried again after 1, 2, 4... pauses; a file cut off is removed."""
    path = Path(target)
    if path.exists() and not force:
        return str(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    for n in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as source, path.open("wb") as out:
                while part := source.read(CHUNK):
                    out.write(part)
            return str(path)
        except urllib.error.HTTPError:
            path.unlink(missing_ok=True)
            raise
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            path.unlink(missing_ok=True)
            if n + 1 == tries:
                raise
            time.sleep(pause * 2**n)
    raise AssertionError


def download_all(urls: dict[str, dict[str, str]], folder: str, force: bool = False) -> dict[str, dict[str, str]]:
    """Paths of what could be fetched; a file that fails is left out."""
    out: dict[str, dict[str, str]] = {}
    for corpus, splits in urls.items():
        for split, url in splits.items():
            try:
                out.setdefault(corpus, {})[split] = download(url, f"{folder}/{corpus}/{Path(url).name}", force)
            except OSError:
                continue
    return out


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, mb, split`` of the files below a folder; the split by the name."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", (F.col("length") / 1e6).alias("mb"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return f.withColumn("split", F.when(F.contains(name, F.lit("test")), "test").when(F.contains(name, F.lit("dev")), "dev").when(F.contains(name, F.lit("train")), "train"))


def is_markup(path: str) -> bool:
    """Whether a landed script is in truth an HTML page."""
    with open(path, encoding="utf-8", errors="replace") as f:
        first = f.readline().lower()
    return "html" in first or "doctype" in first


def read_csv_folder(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of a folder with their headers; rows that can't be read are dropped."""
    return spark.read.option("header", True).option("mode", "DROPMALFORMED").csv(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
