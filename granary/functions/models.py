"""Stand-ins for models, deterministic and offline, behind the column functions that real ones would use."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import overlap_score


def vector(text: str, dim: int = 64) -> np.ndarray:
    """A unit vector seeded by a text's hash."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big"))
    v = rng.standard_normal(dim).astype(np.float32)
    n = float(np.linalg.norm(v))
    return v / n if n else v


def embed(text: Column, dim: int = 64) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else vector(t, dim) for t in texts])

    return F.pandas_udf(run, "array<float>")(text)


def generate(system: str, user: Column, response: str | None = None) -> Column:
    """A fixed response, or the prompt's head and the question."""
    return F.lit(response) if response is not None else F.concat(F.lit(f"[{system[:16]}] "), user)


def rerank(query: Column, text: Column) -> Column:
    return overlap_score(query, text)


def summarize(texts: Column) -> Column:
    """The heads of the first texts, joined."""
    return F.array_join(F.transform(F.slice(texts, 1, 8), lambda t: F.substring(t, 1, 80)), " / ")


def judge_pair(premise: Column, hypothesis: Column) -> Column:
    """(label, confidence) by shared words: much is entailment, some elaboration, little neutral."""
    share = overlap_score(hypothesis, premise)
    label = F.when(share >= 0.5, "entailment").when(share >= 0.2, "elaboration").otherwise("neutral")
    return F.struct(label.alias("label"), share.alias("confidence"))
