"""Exact token counts at every prefix of a text, by dynamic programming over BPE tokens.

A byte-pair encoding of a text is the one sequence of tokens in which each neighbouring pair is what the
merges make of the pair's own characters. So the encoding of a prefix is that of a shorter prefix plus
its last token, and one pass over the characters finds each prefix's last token and count: of the tokens
that end there, the one that may follow the last token of the prefix before it. The counts of all prefixes
are kept: in a task for each chunk of words seen (``Prefixes`` answers for a whole text from them), and
by ``write_prefix_counts`` in a table. Truncation and budget questions, any number of them, are look-ups
in these counts; nothing is encoded again.

For the sentencepiece model, spaces are U+2581, one stands before the text, and a character without a
piece of its own is as many byte tokens as it has UTF-8 bytes. No piece has U+2581 after another
character (checked when the model is loaded), so counts add up over the chunks that begin with it, and a
chunk's counts are kept in a bounded cache.

Defined results: a null text counts as empty, 0 tokens; nothing is truncated or padded; strings of
special tokens are ordinary text; repeated rows each get their row; extra columns are left behind.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.llm.common import arrow_column, released, small_batches, table_of

LIMIT = 4096
CACHE_CHUNKS = 400_000
CACHE_PAIRS = 1_000_000
GROUP = 256
SPACE = "▁"
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PrefixCounter:
    _own: dict[str, "PrefixCounter"] = {}  # one for each Python worker, over its tasks

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        #: The higher the score, the earlier a merge.
        self.score: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece has a space inside: chunks would not be independent")
        self.longest = max(map(len, self.score))
        # between a letter and a mark that no piece has after a letter, merges never cross either
        marks = [m for m in string.punctuation + "\n" if not any(re.search(_LETTER + re.escape(m), p) for p in self.score if m in p)]
        self.cut = re.compile(f"(?<={_LETTER})(?=[{re.escape(''.join(marks))}])") if marks else None
        #: left token -> right token -> whether they may stand side by side
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.totals: dict[str, int] = {}
        #: parts of chunks -> tokens at each of their prefixes
        self.parts: dict[str, Sequence[int]] = {}

    @classmethod
    def of(cls, path: str) -> "PrefixCounter":
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _merged(self, chars: str) -> list[str]:
        """What the merges make of a few characters: always the best scored pair, of equals the leftmost."""
        parts, score = list(chars), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, left: str, right: str) -> bool:
        """Whether right may come directly after left ('' at the beginning) in an encoding."""
        self.n_pairs += 1
        if self.n_pairs > CACHE_PAIRS:
            self.pairs.clear()
            self.n_pairs = 1
        found = self.pairs.setdefault(left, {})[right] = self._merged(left + right) == ([left, right] if left else [right])
        return found

    def chunk_counts(self, chunk: str) -> list[int]:
        """Tokens of chunk[:i], for i from 0 to its length."""
        return self._extended(chunk, [0], [""])

    def _extended(self, chunk: str, counts: list[int], last: list[str]) -> list[int]:
        """Carries counts and last tokens of some prefix of the chunk on to all of it."""
        score, longest, pairs, follows = self.score, self.longest, self.pairs, self._follows
        none: dict[str, bool] = {}
        for i in range(len(counts), len(chunk) + 1):
            # exactly one token ends the encoding of a prefix: mostly the last one and a character more, else likely a short one
            token = last[-1] + chunk[i - 1]
            j = i - len(token)
            if last[-1] and token in score:
                fits = pairs.get(last[j], none).get(token)
                if fits or fits is None and follows(last[j], token):
                    counts.append(counts[j] + 1)
                    last.append(token)
                    continue
            for j in range(i - 1, max(0, i - longest) - 1, -1):
                token = chunk[j:i]
                if token in score:
                    fits = pairs.get(last[j], none).get(token)
                    if fits or fits is None and follows(last[j], token):
                        counts.append(counts[j] + 1)
                        last.append(token)
                        break
            else:  # bytes; what comes next merges with nothing before
                counts.append(counts[-1] + len(chunk[i - 1].encode("utf-8", "surrogatepass")))
                last.append("")
        return counts

    def _split(self, chunk: str) -> list[str]:
        """The parts of a chunk that no merge crosses."""
        return [chunk] if self.cut is None or chunk[1:].isalpha() else self.cut.split(chunk)

    def _learn(self, chunks: set[str]) -> None:
        """Counts of new chunks at all prefixes. In sorted order each part shares a prefix with the one before, whose counts hold for it as well."""
        parts = {c: self._split(c) for c in chunks}
        counts, last, before, kept = [0], [""], "", self.parts
        for part in sorted({p for ps in parts.values() for p in ps}.difference(kept)):
            same = 0
            for x, y in zip(before, part):
                if x != y:
                    break
                same += 1
            del counts[same + 1 :], last[same + 1 :]
            self._extended(part, counts, last)
            kept[part] = bytes(counts) if len(part) < 64 else tuple(counts)  # a character is 4 tokens at most
            before = part
        for c, ps in parts.items():
            self.totals[c] = kept[c][-1] if len(ps) == 1 else sum([kept[p][-1] for p in ps])

    def counts_in(self, chunk: str) -> list[int]:
        """Tokens of chunk[:i], for i from 0 to its length, of the counts that are kept."""
        if chunk not in self.totals:
            self._learn({chunk})
        out = [0]
        for part in self._split(chunk):
            before = out[-1]
            out += [before + n for n in self.parts[part][1:]]
        return out

    def prefix_counts(self, text: str | None) -> list[int]:
        """Tokens of text[:i], for i from 0 to its length. The space that stands before the text counts with its first character."""
        if not text:
            return [0]
        self.prepare([text])
        out = [0]
        for k, chunk in enumerate(self.chunks(text)):
            before = out[-1]
            out += [before + n for n in self.counts_in(chunk)[2 if k == 0 else 1 :]]
        return out

    @staticmethod
    def chunks(text: str) -> list[str]:
        if text[0] != " " and "  " not in text and SPACE not in text:
            return [SPACE + w for w in text.split(" ")]
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE))

    def prepare(self, texts: list[str | None]) -> None:
        """Learn the chunks of some texts at once; the more of them, the more prefixes they share."""
        if len(self.parts) > CACHE_CHUNKS or len(self.totals) > CACHE_CHUNKS:
            self.parts.clear()
            self.totals.clear()
        self._learn(set().union(*[self.chunks(t) for t in texts if t]).difference(self.totals))

    def total(self, text: str | None) -> int:
        """Tokens of the whole text."""
        if not text:
            return 0
        chunks = self.chunks(text)
        try:
            return sum(map(self.totals.__getitem__, chunks))
        except KeyError:
            self.prepare([text])
            return sum(map(self.totals.__getitem__, chunks))

    def longest_prefix(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix with at most so many tokens."""
        return Prefixes(self, text).longest(budget)


class Prefixes:
    """The counts of all prefixes of a text: those where its chunks end, and within them those kept by the counter."""

    def __init__(self, counter: PrefixCounter, text: str | None) -> None:
        self.counter, self.chars = counter, len(text or "")
        self.chunks = counter.chunks(text) if text else []
        if not all(c in counter.totals for c in self.chunks):
            counter.prepare([text])
        self.tokens = [0, *accumulate(map(counter.totals.__getitem__, self.chunks))]
        #: where chunks begin, the space before the text included
        self.begins = [0, *accumulate(map(len, self.chunks))]

    def count(self, chars: int) -> int:
        """Tokens of the first so many characters."""
        at = min(max(chars, 0), self.chars) + 1
        if at == 1:
            return 0
        k = bisect_left(self.begins, at) - 1
        return self.tokens[k] + self.counter.counts_in(self.chunks[k])[at - self.begins[k]]

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix with at most so many tokens."""
        if self.tokens[-1] <= budget:
            return self.chars
        # counts may fall where a merge comes in, so the last prefix that fits is wanted; whole chunks never
        # count less than before, so it ends in the first chunk that goes over the budget
        k = bisect_right(self.tokens, budget) - 1
        inside = self.counter.counts_in(self.chunks[k])
        return max(0, self.begins[k] + max(i for i, c in enumerate(inside) if self.tokens[k] + c <= budget) - 1) if budget >= 0 else 0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, limit: int = LIMIT, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", budgets: Sequence[int] = ()) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit, fit_chars, fits): fit_chars is the length of the longest prefix within the limit, fits those of the budgets."""
    path = model or default_model()
    kind = "struct<n_bytes:bigint,n_tokens:bigint,over_limit:boolean,fit_chars:bigint,fits:array<bigint>>"

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PrefixCounter.of(path)
        for batch in batches:
            size, tokens, fit, fits = [], [], [], []
            for at in range(0, len(batch), GROUP):
                texts = batch.slice(at, GROUP).to_pylist()
                counter.prepare(texts)
                for t in texts:
                    n = counter.total(t)
                    known = Prefixes(counter, t) if n > limit or budgets else None
                    size.append(len(t.encode("utf-8", "surrogatepass")) if t else 0)
                    tokens.append(n)
                    fit.append(known.longest(limit) if known else len(t or ""))
                    fits.append([known.longest(b) for b in budgets] if budgets else [])
            columns = [pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fit, pa.int64()), pa.array(fits, pa.list_(pa.int64()))]
            yield pa.StructArray.from_arrays(columns, names=["n_bytes", "n_tokens", "over_limit", "fit_chars", "fits"])
        released()

    return docs.select(F.col(id_col).alias("_id"), arrow_column(count, kind)(F.col(text_col).cast("string")).alias("_n")).select(F.col("_id").alias(id_col), "_n.*")


def write_prefix_counts(docs: DataFrame, path: str, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store (id_col, counts) of every document, counts[i] the tokens of its first i characters; gives the table read back.

    Neighbouring counts differ little, so the pages are delta-packed. truncated() and tokens_at() read it.
    """
    file = model or default_model()

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PrefixCounter.of(file)
        for batch in batches:
            for at in range(0, len(batch), GROUP):
                yield pa.array([counter.prefix_counts(t.as_py()) for t in batch.slice(at, GROUP)], pa.list_(pa.int32()))
        released()

    out = docs.select(F.col(id_col).alias(id_col), arrow_column(count, "array<int>")(F.col(text_col).cast("string")).alias("counts"))
    with small_batches(docs.sparkSession):
        out.write.options(**{"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}).parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def tokens_at(counts: Column, chars: Column) -> Column:
    """Tokens of the first so many characters, from stored counts."""
    return F.element_at(counts, (F.least(F.greatest(chars, F.lit(0)), F.size(counts) - 1) + 1).cast("int"))


def truncated(counts: Column, budget: Column) -> Column:
    """Characters of the longest prefix with at most so many tokens, from stored counts."""
    over = F.array_position(F.transform(F.reverse(counts), lambda n: n <= budget), True)
    return F.when(over > 0, F.size(counts) - over).otherwise(F.lit(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table_of(spark, sf_dir, "documents")).drop("fits")
