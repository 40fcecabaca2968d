"""The one relation, its checks and the settings."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNKS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
        T.StructField("lexemes", T.ArrayType(T.StringType(), False), False),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("distance", T.DoubleType()),
    ]
)


def bad_rows(chunks: DataFrame, dims: int) -> DataFrame:
    """Rows that break a constraint of the relation: a null, or a vector whose length is not dims."""
    wrong: Column = F.lit(False)
    for f in CHUNKS.fields:
        wrong = wrong | F.col(f.name).isNull()
    return chunks.where(wrong | (F.size("embedding") != dims) | F.exists("embedding", lambda x: x.isNull()))


def repeated_keys(chunks: DataFrame) -> DataFrame:
    """(file_path, chunk_index) that occur more than once."""
    return chunks.groupBy("file_path", "chunk_index").agg(F.count("*").alias("n")).where("n > 1")


def env_file(path: str) -> dict[str, str]:
    """NAME=value lines of a file: `export` before, quotes around the value and # comments are allowed; {} if there is no such file."""
    if not os.path.isfile(path):
        return {}
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            m = re.fullmatch(r"""\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^#\n]*?))\s*(?:#.*)?""", line.rstrip("\n"))
            if m:
                out[m[1]] = next((g for g in m.groups()[1:] if g is not None), "")
    return out


@dataclass
class Settings:
    """Every setting is an environment variable of the same name in capitals, or a line of the file `.env`; an empty one counts as unset.

    embedding_model `hashing` is the offline embedder, any other name a model of model_host. chat_backend `offline` is the
    extractive chat, `none` no chat, `remote` the service at remote_url with chat_key, anything else model_host. distances is `native`, or `blocks`
    for the kernel that suits large tables of wide vectors. search is `scan`, or `index` for a table whose indexes are kept up and used.
    tokens is `words` (runs of letters), or `all` for numbers, hosts, addresses, paths and compounds too, as a database's text search has them.
    bind is the address that the server listens on.
    """

    docs_dir: str = "./docs"
    table_path: str = "./chunks"
    embedding_dims: str = "384"
    embedding_model: str = "hashing"
    model_host: str = "http://localhost:11434"
    chat_backend: str = "offline"
    chat_model: str = ""
    chat_key: str = ""
    remote_url: str = ""
    language: str = "portuguese"
    distances: str = "native"
    search: str = "scan"
    tokens: str = "words"
    bind: str = "127.0.0.1"
    port: str = "8080"

    @classmethod
    def load(cls, env: dict[str, str] | None = None, file: str = ".env") -> Settings:
        """env (the environment) goes before the file, which need not be there."""
        env = env_file(file) | {k: v for k, v in (os.environ if env is None else env).items() if v}
        return cls(**{f.name: v for f in fields(cls) if (v := env.get(f.name.upper(), ""))})

    @property
    def dims(self) -> int:
        return int(self.embedding_dims)
