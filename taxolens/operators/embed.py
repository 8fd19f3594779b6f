"""V1: text → vectors as a batch-inference job.

The built-in encoder is a Spark ML pipeline (tokenise → hashed term
frequencies → IDF → L2 normalise); IDF is a distributed aggregate. Any other
encoder is a plug-in: a callable that maps a pandas Series of texts to a 2-D
array, run with ``mapInPandas`` so the model loads once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.schema import ROW_ID


def embed_text(df: DataFrame, text_col: str = "cluster_text", encoder: str | Callable = "tfidf",
               num_features: int = 512, out: str = "features", batch_size: int = 64) -> DataFrame:
    """Add ``out: array<double>`` to ``df``."""
    if encoder == "tfidf":
        return _tfidf(df, text_col, num_features, out)
    if callable(encoder):
        return _plugin(df, text_col, encoder, out, batch_size)
    raise ValueError(f"unknown encoder {encoder!r}")


def _tfidf(df: DataFrame, text_col: str, num_features: int, out: str) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"\W+", minTokenLength=2),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_n", p=2.0),
    ])
    model = pipe.fit(df)
    return (model.transform(df).withColumn(out, vector_to_array("_n"))
            .drop("_tok", "_tf", "_idf", "_n"))


def _plugin(df: DataFrame, text_col: str, encode: Callable, out: str, batch_size: int) -> DataFrame:
    schema = df.schema.add(out, "array<double>")

    def run(it):
        for pdf in it:
            texts = pdf[text_col].fillna("")
            vecs = []
            for i in range(0, len(texts), batch_size):
                vecs.append(np.asarray(encode(texts.iloc[i:i + batch_size]), dtype=np.float64))
            mat = np.vstack(vecs) if vecs else np.zeros((0, 0))
            pdf[out] = list(mat)
            yield pdf

    return df.mapInPandas(run, schema)


def hashed_char_ngrams(dim: int = 256, n: int = 3) -> Callable[[pd.Series], np.ndarray]:
    """A dependency-free plug-in encoder (character n-gram hashing, L2-normalised)."""
    import xxhash

    def enc(texts: pd.Series) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            t = f" {t.lower()} "
            for j in range(len(t) - n + 1):
                out[i, xxhash.xxh32_intdigest(t[j:j + n]) % dim] += 1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1.0, norms)

    return enc


def text_rows(df: DataFrame, text_col: str = "cluster_text") -> DataFrame:
    return df.select(ROW_ID, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
