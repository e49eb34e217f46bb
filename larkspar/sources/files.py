"""Source files of a project, by language: which are listed, and reading them whole."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Walk:
    """Extensions (exact case) that count, folders that are skipped (the root too, if it has such a name), endings that are dropped."""

    extensions: frozenset[str]
    skip: frozenset[str]
    drop: tuple[str, ...] = ()


def _walk(extensions: str, skip: str, drop: str = "") -> Walk:
    return Walk(frozenset(extensions.split()), frozenset(skip.split()), tuple(drop.split()))


#: What each language lists and skips.
WALKS = {
    "rust": _walk("rs", "target"),
    "swift": _walk("swift", ".build build Build DerivedData Pods SourcePackages Checkouts"),
    "typescript": _walk("ts tsx js jsx mjs cjs", "node_modules dist build .next .nuxt coverage .git .turbo .cache", ".d.ts .config.ts .config.js .config.mjs"),
    "vue": _walk("vue ts tsx js jsx mjs cjs", "node_modules dist build .next .nuxt coverage .git .turbo .cache .output", ".d.ts .config.ts .config.js .config.mjs"),
    "java": _walk("java", "build .gradle target .git .idea .settings bin out .mvn node_modules"),
}


def list_files(root: str, language: str) -> list[str]:
    """Paths below root, hidden ones included, sorted."""
    walk = WALKS[language]
    found = []
    if os.path.basename(os.path.normpath(root)) in walk.skip:
        return found
    for folder, folders, names in os.walk(root, followlinks=True):
        folders[:] = sorted(d for d in folders if d not in walk.skip)
        for name in names:
            stem, dot, ext = name.rpartition(".")
            if dot and stem and ext in walk.extensions and not name.endswith(walk.drop or ("\0",)):
                found.append(os.path.join(folder, name))
    return sorted(found)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_path, content) of files that every executor can open; a file that is not UTF-8 is an error. Files are read where they are parsed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["file_path"]:
                with open(p, encoding="utf-8", newline="") as f:
                    yield pd.DataFrame({"file_path": [p], "content": [f.read()]})

    return spark.createDataFrame([(p,) for p in paths], "file_path string").mapInPandas(read, "file_path string, content string")


def source_files(spark: SparkSession, root: str, language: str) -> DataFrame:
    return read_files(spark, list_files(root, language))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, content) of a folder in any file system Spark reads (hidden files are not listed there)."""
    got = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return got.selectExpr("_metadata.file_path AS file_path", "value AS content")
