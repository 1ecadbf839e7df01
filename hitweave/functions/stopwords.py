"""Lists of stop words.  A job takes a collection of words, none, or the name of a language, which stands
for the public list that Spark's own StopWordsRemover uses, read from the installed library (no session is needed)."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Collection
from functools import cache
from pathlib import Path

import pyspark

_LIST = "org/apache/spark/ml/feature/stopwords/{}.txt"


@cache
def public_list(language: str = "english") -> tuple[str, ...]:
    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    for jar in (j for home in homes if home for j in sorted(Path(home).glob("jars/spark-mllib_*.jar"))):
        with zipfile.ZipFile(jar) as files:
            if _LIST.format(language) in files.namelist():
                return tuple(files.read(_LIST.format(language)).decode().split())
    raise ValueError(f"the installed Spark has no stop words for {language!r}")


def listed(stop_words: str | Collection[str] | None) -> list[str]:
    """The words meant by a ``stop_words`` argument."""
    return sorted(set(public_list(stop_words) if isinstance(stop_words, str) else stop_words or ()))
