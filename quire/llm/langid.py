"""Language identification with segmentation-marginalised unigrams.

For each language, piece probabilities over a fixed public vocabulary are
estimated from labelled documents; a text's score under a language sums over
all segmentations of each word (see ``lattice``). The best language wins.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lattice import VOCABULARY, log_probabilities
from .lm_score import lattice_column, piece_counts, word_counts
from .shared import Frame, cut, drop

#: About so many labelled documents of each language are fitted on.
PER_LANGUAGE = 3000
#: Languages that are scored together; more are scored in so many passes over the text, which bounds a task's memory.
AT_ONCE = 64


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray
    path: str
    name: str


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE, smooth: float = 0.5, vocabulary_path: str = VOCABULARY) -> LanguageModel:
    """Piece probabilities of each language that labels a document, however many.

    Fits on a bounded sample: a document of a language with n labelled ones is
    taken with probability ``per_language / n``, decided by a hash of its text,
    so repeated rows are taken together and the sample is the same at each run.
    Rows with a null label or text aren't used. The driver holds one row of
    piece probabilities for each language.
    """
    fr = Frame(docs)
    lang, text = fr[lang_col].cast("string"), fr[text_col]
    share = fr.df.select(lang.alias("k")).where("k is not null").groupBy("k").count().select("k", F.least(F.lit(1.0), per_language / F.col("count")).alias("share"))
    share, path = cut(share)
    u = (F.xxhash64(text).bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)
    sample = fr.df.join(share, lang == F.col("k")).where(text.isNotNull() & (u < F.col("share")))
    counts = piece_counts(word_counts(sample, text, {"lang": lang}), vocabulary_path, ("lang",))
    drop(docs.sparkSession, path)
    languages = sorted(k[0] for k in counts)
    if not languages:
        return LanguageModel([], np.zeros((0, 0)), vocabulary_path, uuid.uuid4().hex)
    scores = log_probabilities(np.stack([counts[(k,)] for k in languages]), smooth)
    return LanguageModel(languages, scores, vocabulary_path, uuid.uuid4().hex)


PASS = "struct<best:string,top:double,second:double,own:double,n:bigint>"


def _passes(model: LanguageModel, spark, text: Column, lang: Column) -> list[Column]:
    """For each group of languages: the best with its log-probability, the second's, that of the declared one (null if it isn't in the group) and the number of words; null without words."""

    def after(names):
        code = pa.array(names)

        def of(v, n, declared):
            best = v.argmax(axis=1) if len(v) else np.zeros(0, int)
            row = np.arange(len(v))
            top = v[row, best]
            rest = v.copy()
            rest[row, best] = -np.inf
            second = rest.max(axis=1) if len(v) else np.zeros(0)
            at = pc.index_in(declared.cast(pa.string()), code).fill_null(-1).to_numpy(zero_copy_only=False)
            own = pa.array(v[row, at] if len(v) else np.zeros(0), mask=at < 0)
            return pa.StructArray.from_arrays([code.take(pa.array(best)), pa.array(top), pa.array(second), own, pa.array(n)], names=["best", "top", "second", "own", "n"], mask=pa.array(n == 0))

        return of

    groups = [slice(s, s + AT_ONCE) for s in range(0, len(model.languages), AT_ONCE)]
    return [lattice_column(f"{model.name}-{k}", spark, model.scores[g], text, model.path, after(model.languages[g]), PASS, lang) for k, g in enumerate(groups)]


def accept(docs: DataFrame, model: LanguageModel, lang_col: str = "lang", text_col: str = "text", odds: float = 20.0, per_word: float = 3.0, out: bool = True) -> DataFrame:
    """The documents whose declared language isn't contradicted.

    A document is rejected if the best language is another than the declared
    one and its log-probability exceeds the declared one's by more than
    ``odds`` nats and by more than ``per_word`` nats a word (a text wholly in
    another language leads by 6 to 9 a word, one that mixes two by less than
    3). Kept are therefore: texts without words (null, empty), those
    without a declared language or with one that the model doesn't know, and
    short texts that can't tell. Adds ``lang_found`` (null for texts without
    words), ``lang_logprob`` and ``lang_lead`` over the second (infinite if
    there is one language only) if ``out``; input columns of these names give
    way, all others stay whatever they are called. Repeated rows are judged
    alike; an empty table stays empty.
    """
    fr = Frame(docs)
    cols = _passes(model, docs.sparkSession, fr[text_col], fr[lang_col].cast("string"))
    d = fr.df.select("*", *[c.alias(f"p{k}") for k, c in enumerate(cols)])
    if not cols:
        d = d.withColumn("l", F.lit(None).cast(PASS))
    elif len(cols) == 1:
        d = d.withColumnRenamed("p0", "l")
    else:
        p = [F.col(f"p{k}") for k in range(len(cols))]
        order = lambda a, b: F.when(a["top"] > b["top"], -1).when(a["top"] < b["top"], 1).otherwise(0)
        best = F.array_sort(F.array(*p), order)  # stable: the first language on a tie, as within a group
        first, second = best[0], best[1]
        made = F.struct(first["best"].alias("best"), first["top"].alias("top"), F.greatest(first["second"], second["top"]).alias("second"), F.coalesce(*[x["own"] for x in p]).alias("own"), first["n"].alias("n"))
        d = d.withColumn("l", F.when(p[0].isNotNull(), made)).drop(*[f"p{k}" for k in range(len(cols))])
    gap = F.coalesce(F.col("l.top") - F.col("l.own"), F.lit(0.0))
    kept = d.where(~((gap > odds) & (gap > F.coalesce(F.col("l.n"), F.lit(0)) * F.lit(per_word))))
    return fr.close(kept, lang_found=F.col("l.best"), lang_logprob=F.col("l.top"), lang_lead=F.col("l.top") - F.col("l.second")) if out else fr.close(kept)
