"""Exact token counts of every prefix of a text, for byte-level BPE vocabularies.

A text is split into words as the vocabulary's own splitter does.  Within a word a
dynamic program goes from prefix to prefix: the encoding of a prefix ends with the
one token that is a suffix of it and may follow the encoding of the prefix before
that token, so its count is one more than the count there.  Two tokens may follow
each other if their joint bytes are encoded as these two.  Words repeat, so the
program runs once for each distinct word of a slice, and numpy adds the words up.

A prefix may be split otherwise than the whole text: white space at its end is one
word, and a cut contraction is two.  These places are counted by themselves.  A
special string is one token, and its beginnings are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._text import column, kept, slices

#: Code points in a block of the table of prefixes.
BLOCK = 512
#: Words that a process remembers: two generations of so many.
REMEMBERED = 200_000
#: Longer words are not remembered.
LONGEST = 64
#: Pairs of tokens that a process remembers.
PAIRS = 200_000
#: A longer text is counted in stretches of about so many code points, cut before a single space between words.
STRETCH = 1 << 20
#: Slices of texts that are counted together, in bytes.
SLICE = 1 << 20

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
#: The contractions that byte-level splitters keep together.
SHORT_FORMS = ("s", "t", "m", "d")
LONG_FORMS = ("re", "ve", "ll")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PrefixCounter:
    """The vocabulary with what a process has counted lately."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not plain or spec["normalizer"] or spec["model"].get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("prefix counts need a byte-level BPE that splits by the usual pattern, without a normalizer")
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        signs = {s: b for c in map(chr, range(0x300)) for b, s in zip(c.encode(), spelt.pre_tokenize_str(c)[0][0], strict=True)}
        # Bytes that the characters above lack begin no character below 0x300; a vocabulary spells every byte by one sign.
        rest = iter(sorted(b for b in range(256) if b not in signs.values()))
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        for s in sorted(t for t in tokens if len(t) == 1 and t not in signs):
            signs[s] = ord(s) if ord(s) < 256 else next(rest)
        self.names = {i: t for t, i in tokens.items()}
        #: Every suffix of a token, with the token's number if it is one itself, else -1.
        self.ends: dict[bytes, int] = {}
        for token, number in tokens.items():
            spelling = bytes(signs[s] for s in token)
            for k in range(1, len(spelling)):
                self.ends.setdefault(spelling[k:], -1)
            self.ends[spelling] = number
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.pairs: dict[int, bool] = {}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, points: np.ndarray) -> None:
        """Asks the splitter which class the characters belong to: they join a letter, a digit, a sign or none."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            self.kind[p] = next((k for k, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(before + chr(p))) == 1), SPACE)

    def _fits(self, first: int, second: int) -> bool:
        key = first << 32 | second
        known = self.pairs.get(key)
        if known is None:
            known = [t.id for t in self.tokenizer.model.tokenize(self.names[first] + self.names[second])] == [first, second]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def words(self, words: list[bytes]) -> Iterator[bytes]:
        """For each word the counts of all prefixes that end with a whole character, as 32-bit numbers.

        Words in sorted order share the work on what they begin with alike.
        """
        ends, before, last, count = self.ends, b"", [0], [0]
        for word in words:
            n, known = len(word), 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                known += 1
            del last[known + 1 :], count[known + 1 :]
            before = word
            for i in range(known + 1, n + 1):
                found = []
                for j in range(i - 1, -1, -1):
                    number = ends.get(word[j:i])
                    if number is None:
                        break
                    if number >= 0:
                        found.append((j, number))
                for j, number in reversed(found):
                    if not j or self._fits(last[j], number):
                        last.append(number)
                        count.append(count[j] + 1)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            whole = count[1:]
            if not word.isascii():
                whole = [c for i, c in enumerate(whole, 1) if i == n or word[i] & 0xC0 != 0x80]
            yield array("i", whole).tobytes()

    def _known(self, words: list[bytes]) -> list[bytes]:
        out = [self.young.get(w) or self.old.get(w) for w in words]
        new = sorted((w, k) for k, w in enumerate(words) if out[k] is None)
        for (_, k), counts in zip(new, self.words([w for w, _ in new]), strict=True):
            out[k] = counts
        self.young |= {w: counts for w, counts in zip(words, out, strict=True) if len(w) <= LONGEST}
        if len(self.young) > REMEMBERED:  # a full generation replaces the one before it
            self.young, self.old = {}, self.young
        return out

    def _counted(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The counts of the prefixes of the distinct words in a row, where those of each word begin, and each word's total."""
        named = words.dictionary_encode()
        known = self._known(named.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.int32)
        begins = np.cumsum(sizes) - sizes
        word = named.indices.to_numpy()
        return flat, begins[word], flat[begins + sizes - 1][word]

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The counts of all prefixes of each piece of ordinary text, in a row; the pieces' ends; bytes of each character."""
        joined = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        n = len(points)
        if not n:
            return np.empty(0, np.int64), ends, np.empty(0, np.int64)
        kind = self.kind[points]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(points[kind == UNKNOWN]))
            kind = self.kind[points]
        begins = np.zeros(n + 3, bool)  # of pieces; the end of all is one too
        begins[np.concatenate(([0], ends))] = True
        begins[n:] = True
        start = np.zeros(n + 3, bool)
        start[:n] = begins[:n]
        start[1:n] |= kind[1:] != kind[:-1]
        # The last white space before other text is a word of its own; a space joins that text.
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~begins[1:n]) + 1
        opening = np.flatnonzero((kind == SPACE) & start[:n])
        opening = opening[np.searchsorted(opening, after) - 1]  # where the white space before ``after`` begins
        start[after - 1] = True
        start[after[points[after - 1] == 32]] = False
        # Contractions.
        mark = np.flatnonzero((points == ord("'")) & start[:n])
        padded = np.concatenate((points, np.zeros(3, points.dtype)))
        one = np.isin(padded[mark + 1], [ord(c) for c in SHORT_FORMS]) & ~begins[mark + 1]
        two = np.logical_or.reduce([(padded[mark + 1] == ord(a)) & (padded[mark + 2] == ord(b)) for a, b in LONG_FORMS]) & ~begins[mark + 1] & ~begins[mark + 2]
        start[mark[one | two] + 1] = False
        start[mark[one] + 2] = True
        start[mark[two] + 3] = True
        at = np.flatnonzero(start[:n])
        size = np.diff(np.append(at, n))
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.concatenate(([0], np.cumsum(width)))
        data = pa.py_buffer(joined.encode())
        cut = lambda where: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(where) - 1, [None, pa.py_buffer(place[where]), data])
        flat, begin, total = self._counted(cut(np.append(at, n)))
        before = np.cumsum(total, dtype=np.int64) - total
        first = np.searchsorted(at, np.concatenate(([0], ends[:-1])))  # the first word of each piece
        lengths = np.diff(np.concatenate(([0], ends)))
        base = np.repeat(before, size) - np.repeat(np.append(before, 0)[first], lengths)
        counts = base + flat[np.arange(n) - np.repeat(at, size) + np.repeat(begin, size)]
        # White space of several characters before other text, where the prefix ends with all of it.
        long = after - opening > 1
        if long.any():
            opening, after = opening[long], after[long]
            spaces = cut(np.append(np.column_stack((opening, after)).ravel(), n)).take(pa.array(np.arange(len(after)) * 2))
            counts[after - 1] = base[opening] + self._counted(spaces)[2]
        counts[mark[two] + 1] = base[mark[two]] + 2
        return counts, ends, width

    def _stretches(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > STRETCH:
            cut = _BETWEEN.search(text, start + STRETCH)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def _parts(self, text: str) -> Iterator[tuple[str, str]]:
        """Stretches of ordinary text, each with the special string that follows it or nothing."""
        start = 0
        for hit in self.special.finditer(text) if self.special else ():
            *most, final = self._stretches(text[start : hit.start()])
            yield from ((m, "") for m in most)
            yield final, hit.group()
            start = hit.end()
        yield from ((m, "") for m in self._stretches(text[start:]))

    def texts(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """For each text the token counts of its prefixes of 1, 2, ... code points, and its bytes."""
        simple = [len(t) <= STRETCH and not (self.special and self.special.search(t)) for t in texts]
        counts, ends, width = self.pieces([t for t, s in zip(texts, simple, strict=True) if s])
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        place = np.concatenate(([0], np.cumsum(width)))
        each = iter([(counts[a:b], int(place[b] - place[a])) for a, b in zip(begins.astype(int).tolist(), ends.astype(int).tolist(), strict=True)])
        out, sizes = [], []
        for text, s in zip(texts, simple, strict=True):
            made, size = next(each) if s else self._long(text)
            out.append(made)
            sizes.append(size)
        return out, sizes

    def _long(self, text: str) -> tuple[np.ndarray, int]:
        made, base, size = [], 0, 0
        for piece, special in self._parts(text):
            counts, _, width = self.pieces([piece + special[:-1]])
            made.append((counts + base).astype(np.int32))
            base += int(counts[len(piece) - 1]) if piece else 0
            size += int(width.sum())
            if special:
                base += 1
                made.append(np.array([base], np.int32))
                size += len(special[-1].encode())
        return np.concatenate(made), size


#: A space between two ASCII letters or digits: words begin there whatever follows, and nothing before depends on what comes after.
_BETWEEN = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def prefix_counter(path: str) -> PrefixCounter:
    """The one instance of this process, so that tasks that follow find the words of those before."""
    return kept(f"prefixes {path}", lambda: PrefixCounter(path))


def prefix_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """The token counts of all prefixes of each text, in blocks of ``block`` code points; one narrow pass.

    Columns: the id; ``block`` from 0; ``start``, the code points before it;
    ``before``, the tokens of the prefix of ``start`` code points; ``steps``, for each
    code point of the block by how much the count changes when the prefix grows
    by it; ``least``, the smallest count of the block's prefixes, which in block 0 include the
    empty one; ``least_later``, that of all later blocks (null in the last);
    ``n_chars``, ``n_bytes`` and ``n_tokens`` of the whole text on each row.

    A null text is empty; an empty one has one block without steps.  Ids may be
    null and rows may repeat: each row has its own blocks.  A text of any length is
    counted in stretches; other columns are not read.  An empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    kind = df.schema[id_col].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in slices(batches, "_text", SLICE):
            texts = [t or "" for t in column(batch, "_text").to_pylist()]
            counts, n_bytes = counter.texts(texts)
            del texts
            chars = np.array([len(c) for c in counts])
            many = np.maximum(1, -(-chars // block))
            which = np.repeat(np.arange(len(counts)), many)
            first = np.cumsum(many) - many
            number = np.arange(len(which)) - first[which]
            start, flat = number * block, np.concatenate(counts)
            size = np.minimum(block, chars[which] - start)
            place = (np.cumsum(chars) - chars)[which] + start
            full = size > 0  # all but the one block of an empty text
            before, least, total = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64), np.zeros(len(counts), np.int64)
            if full.any():
                least[full] = np.minimum.reduceat(flat, place[full])
                before[start > 0] = flat[place[start > 0] - 1]
                total[chars > 0] = flat[np.cumsum(chars)[chars > 0] - 1]
            later = np.full(len(which), -1, np.int64)
            for f, m in zip(first[many > 1].tolist(), many[many > 1].tolist(), strict=True):
                later[f : f + m - 1] = np.minimum.accumulate(least[f + m - 1 : f : -1])[::-1]
            least[number == 0] = 0
            steps = np.diff(flat, prepend=0).astype(np.int32)
            begins = place[full & (number == 0)]
            steps[begins] = flat[begins]
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            whole = [chars[which], np.array(n_bytes)[which], total[which]]
            long = [pa.array(x, pa.int64(), mask=m) for x, m in ((start, None), (before, None), (least, None), (later, later < 0), *((x, None) for x in whole))]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(steps))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "_id").take(pa.array(which)), pa.array(number, pa.int32()), *long[:2], lists, *long[2:]],
                ["_id", "block", "start", "before", "steps", "least", "least_later", "n_chars", "n_bytes", "n_tokens"],
            )

    schema = f"_id {kind}, block int, start bigint, before bigint, steps array<int>, least bigint, least_later bigint, n_chars bigint, n_bytes bigint, n_tokens bigint"
    return df.select(df[id_col].alias("_id"), df[text_col].alias("_text")).mapInArrow(build, schema).withColumnRenamed("_id", id_col)


def cut_to_budget(table: DataFrame, budget: int | Column) -> DataFrame:
    """One row per text of a table of prefixes: ``cut_chars``, the longest prefix of at most ``budget`` tokens, and its ``cut_tokens``.

    The block that has the answer says so itself: a prefix of it is cheap enough
    and none of a later block is, so no rows meet.  ``budget`` may differ by row if it is
    a column; a negative or null one has no answer and no row.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    holds = table.where((F.col("least") <= limit) & (F.col("least_later").isNull() | (F.col("least_later") > limit)))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.col("before").alias("tokens"), F.lit(0).cast("long").alias("best"), F.col("before").alias("kept"))

    def grow(a: Column, x: Column) -> Column:
        at, tokens = a["at"] + 1, a["tokens"] + x
        ok = tokens <= limit
        return F.struct(at.alias("at"), tokens.alias("tokens"), F.when(ok, at).otherwise(a["best"]).alias("best"), F.when(ok, tokens).otherwise(a["kept"]).alias("kept"))

    # Of a text within the budget nothing is cut; the steps of others are added up.
    whole = F.struct(F.col("n_chars").alias("chars"), F.col("n_tokens").alias("tokens"))
    cut = F.aggregate("steps", zero, grow, lambda a: F.struct((F.col("start") + a["best"]).alias("chars"), a["kept"].alias("tokens")))
    found = holds.withColumn("_cut", F.when(F.col("n_tokens") <= limit, whole).otherwise(cut))
    return found.select(*[c for c in table.columns if c not in ("block", "start", "before", "steps", "least", "least_later")], F.col("_cut.chars").alias("cut_chars"), F.col("_cut.tokens").alias("cut_tokens"))


def tokens_at(table: DataFrame, asked: DataFrame, id_col: str = "doc_id", at_col: str = "at_chars", block: int = BLOCK) -> DataFrame:
    """``asked`` (id, number of code points, any other columns) with ``tokens``, the count of that prefix of each such text.

    A number beyond the text's end counts the whole text; a negative or null
    one, and an id without a text, gives null.  ``block`` is that of the table.
    """
    mine = [c for c in asked.columns if c not in (id_col, at_col)]
    left = asked.select(F.col(id_col).alias("_id"), F.col(at_col).alias("_at"), *[F.col(c).alias(f"_own_{i}") for i, c in enumerate(mine)])
    held = table.select(F.col(id_col).alias("_key"), "block", "start", "before", "steps", "n_chars", F.col("least_later").isNull().alias("_final"))
    wanted = F.greatest(F.lit(0), F.floor((F.col("_at") - 1) / block)).cast("int")
    # The last block answers for what lies beyond it, so it is dealt to its own number only, and the question is clipped.
    ends = held.where("_final").select(F.col("_key").alias("_end_key"), F.col("n_chars").alias("_end"))
    clipped = left.join(ends, F.col("_id") == F.col("_end_key"), "left").withColumn("_at", F.least("_at", "_end"))
    met = clipped.join(held, (F.col("_id") == F.col("_key")) & (wanted == F.col("block")) & (F.col("_end") == F.col("n_chars")), "left")
    count = F.col("before") + F.aggregate(F.slice("steps", F.lit(1), F.greatest(F.lit(0), F.col("_at") - F.col("start")).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    return met.select(F.col("_id").alias(id_col), F.when(F.col("_end").isNotNull(), F.col("_at")).alias(at_col), *[F.col(f"_own_{i}").alias(c) for i, c in enumerate(mine)], F.when(F.col("_at") >= 0, count).alias("tokens"))
