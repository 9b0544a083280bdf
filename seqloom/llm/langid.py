"""Language identification: words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import common


#: Runs of letters and of numbers that aren't digits, such as ½ and ②, which letters_of() takes out.
RUNS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def letters_of(run: str) -> list[str]:
    """The runs of letters, as Unicode has them (general category L), in one of RUNS."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities per language, of words and of n-grams; words stand between blanks in n-grams.

    `words` and `grams` give the line of an item in word_scores and gram_scores, which are lines of float64, one number per language.
    """

    langs: tuple[str, ...]
    words: dict[str, int]
    word_scores: bytes
    grams: dict[str, int]
    gram_scores: bytes
    longest: int

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(x).reshape(-1, max(len(self.langs), 1)) for x in (self.word_scores, self.gram_scores))

    def parts(self, word: str) -> list[int]:
        """Lines of an unseen word's n-grams: for each position the longest known one that starts there."""
        padded, found, get, lengths = f" {word} ", [], self.grams.get, range(self.longest, 0, -1)
        for i in range(len(padded) - 1):
            for n in lengths:
                at = get(padded[i : i + n])
                if at is not None:
                    found.append(at)
                    break
        return found

    def score(self, runs: list[str], lines: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each of some RUNS the sum of its words' scores, and whether it has a letter.

        A known word has its own score; an unseen one the mean over its parts().
        """
        words, grams = lines or self.lines()
        table, lettered = np.zeros((len(runs), len(self.langs))), np.ones(len(runs), bool)
        known, unseen, flat, sizes = ([], []), [], [], []
        for i, run in enumerate(runs):
            if not run.isalpha():
                inner = letters_of(run)
                lettered[i] = bool(inner)
                if inner:
                    table[i] = self.score(inner, (words, grams))[0].sum(axis=0)
            elif (at := self.words.get(run)) is not None:
                known[0].append(i), known[1].append(at)
            elif found := self.parts(run):
                unseen.append(i), sizes.append(len(found))
                flat += found
        table[known[0]] = words[known[1]]
        if unseen:
            sizes = np.array(sizes)
            table[unseen] = np.add.reduceat(grams[flat], np.cumsum(sizes) - sizes) / sizes[:, None]
        return table, lettered

    def scorer(self, memo_words: int = 1 << 17):
        """text -> (language, its probability). The memo of word scores is emptied when it is full; it holds 4096 words at least."""
        memo_words = max(memo_words, 4096)
        table, lettered, lines = np.zeros((memo_words, len(self.langs))), np.zeros(memo_words, bool), self.lines()

        class Memo(dict):
            new: list[str] = []

            def __missing__(memo, run: str) -> int:
                memo[run] = at = len(memo)
                memo.new.append(run)
                return at

        memo = Memo()

        def score(text: str | None) -> tuple[str, float]:
            runs = RUNS.findall(text.lower()) if text else []
            if not self.langs:
                return UNKNOWN, 0.0
            total, any_letter = np.zeros(len(self.langs)), False
            for start in range(0, len(runs), 4096):
                part = runs[start : start + 4096]
                if len(memo) + len(part) > memo_words:
                    memo.clear()
                at = np.fromiter(map(memo.__getitem__, part), np.int64, len(part))
                if memo.new:
                    fresh = slice(len(memo) - len(memo.new), len(memo))
                    table[fresh], lettered[fresh] = self.score(memo.new, lines)
                    memo.new.clear()
                total += table[at].sum(axis=0)
                any_letter = any_letter or bool(lettered[at].any())
            if not any_letter:
                return UNKNOWN, 0.0
            best = int(total.argmax())
            return self.langs[best], float(1.0 / np.exp(np.minimum(total - total[best], 0.0)).sum())

        return score


def _log_frequencies(rows: list, langs: list[str], floor: float) -> tuple[dict[str, int], bytes]:
    """Lines of log frequencies, above the floor of an item that a language hasn't shown; rows: item, by_lang (lang: share)."""
    at = {x: i for i, x in enumerate(langs)}
    rows = sorted(rows, key=lambda r: r["item"])
    scores = np.full((len(rows), len(langs)), math.log(floor))
    for i, r in enumerate(rows):
        for lang, share in r["by_lang"]:
            scores[i, at[lang]] = math.log(max(share, floor))
    return {r["item"]: i for i, r in enumerate(rows)}, scores.tobytes()


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", most_rows: int = 4000, longest: int = 4, order_col: str = "doc_id") -> LanguageModel:
    """Learns from at most `most_rows` different labelled rows, those with the smallest hash of `order_col`, text and label: a bounded sample by design.

    Spark counts words and n-grams; all that come more than once in the sample come to the driver, so the model is bounded by the
    sample, whatever the input. Null labels and null texts teach nothing; repeated rows count once. Without any labelled row the model
    has no language, and predicts `und`.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(order_col).cast("string").alias("by"))
    rows = common.hash_sample(rows, F.concat_ws(":", "by", F.xxhash64("text").cast("string"), "lang"), most_rows, 5)
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("item")).groupBy("lang", "item").agg(F.count("*").alias("n"))
    words = words.persist()
    padded = F.concat(F.lit(" "), F.col("item"), F.lit(" "))
    starts = F.sequence(F.lit(1), F.length("item") + 1)
    spans = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("item") + 3 - i)), lambda n: F.substring(padded, i, n))))
    grams = words.select("lang", "n", F.explode(spans).alias("item")).groupBy("lang", "item").agg(F.sum("n").alias("n"))

    def known(counts: DataFrame) -> list:
        totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        shares = counts.join(totals, "lang").groupBy("item").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", (F.col("n") / F.col("total")).alias("share"))).alias("by_lang"))
        return shares.where("all > 1").select("item", "by_lang").collect()

    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    model = LanguageModel(tuple(langs), *_log_frequencies(known(words), langs, 1e-7), *_log_frequencies(known(grams), langs, 1e-6), longest)
    words.unpersist()
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (its probability, 0 to 1) from the whole text; input columns with these names are replaced.

    Null, empty and letterless texts get `und` with score 0. Ties go to the language that sorts first; repeated rows are judged alike; an
    empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.word_scores, model.grams, model.gram_scores, model.longest))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def scored(batches):
            score = LanguageModel(*held.value).scorer()
            for batch in batches:
                found = [score(x) for at in range(0, len(batch), 500) for x in batch.slice(at, 500).to_pylist()]
                yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

        yield from common.lean(scored)(texts)

    kept = [c for c in docs.columns if c not in {"lang_pred", "score"}]
    found = docs.select(*kept, predict(F.col(text_col).cast("string")).alias("__found"))
    return found.select(*kept, "__found.lang_pred", "__found.score")
