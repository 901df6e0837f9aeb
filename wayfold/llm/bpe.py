"""BPE encoding and decoding of whole texts, exactly as the tokenizers library gives them for the whole text.

Texts are cut where a cut changes nothing: before a space or line feed that follows a character that is not white space
(no pretoken, special token or composed character reaches over that place), and between an ASCII letter and a full stop
or comma. Distinct pieces are encoded once. A piece that stays long because nothing in it can be cut safely is encoded
by tree concatenation: halves are encoded in parallel, then growing windows around each join are encoded again until
the window agrees with both sides; in the limit the window is the whole piece. Agreement of neighbouring tokens is
enough: a sequence of BPE tokens is the encoding of its text if each pair of neighbours is.

Defined results: a null text is empty and has no tokens; special-token strings in a text become their ids, as the
library does by default; other columns are ignored; repeated rows each give a row; very long texts are encoded whole;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import lean, slices, table

#: Characters of a piece from which on it is encoded as a tree, and characters of a leaf.
LONG, LEAF = 8192, 4096
#: First window, in characters to each side of a join, and tokens that must agree in a row on each side.
WINDOW, AGREE = 64, 4
#: Pieces that a worker remembers, at most, and bytes of the longest of them.
REMEMBER, SHORT = 300_000, 64
#: Pieces that are encoded as one input.
TOGETHER = 1000
#: Values that are laid out at a time, and bytes of text that are encoded and decoded at a time: they bound a worker's memory, not what is encoded.
SPAN, PART = 1 << 18, 4 << 20

_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])|(?<=[A-Za-z])(?=[.,])")
#: What the word tokenizer splits lower-case text into, and characters for which that isn't told by this expression alone,
#: since folding or composing may change them: all but ASCII, letters of western Europe, and common marks.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+"
_OTHERS = r"[^\x00-\x7F\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}\x{A1}\x{AB}\x{BB}\x{BF}\x{2013}\x{2014}\x{2018}-\x{201E}\x{2026}]"
_UNSAFE_SPACE = r"[\s\pZ\x0b\x1c-\x1f\x{85}] "


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The library's tokenizer from a file, with a bounded memory of pieces: a column of strings and their ids end to end."""

    _open: dict = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # Tokens that end a word by the model's suffix, or that begin with a space. Where words are closed, spaces count for nothing.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closed = bool(suffix)
        self.marks = np.zeros(max(vocab.values(), default=-1) + 1, bool)
        self.marks[[i for t, i in vocab.items() if (t.endswith(suffix) if suffix else t.startswith("\u0120"))]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.at, self.used = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process and file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    # -- pieces -----------------------------------------------------------------------------------------------------
    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, each a space and a word without white space: a buffer of ids, and where each piece's begin and how many they are."""
        found = pc.index_in(words, value_set=self.known)
        new = found.is_null().to_numpy(zero_copy_only=False)
        place = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = words.filter(pa.array(new))
        more, size = self.encode_new(fresh)
        buffer = np.concatenate((self.ids, more))
        begin, length = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        old = place[~new]
        begin[~new], length[~new] = self.at[old], self.at[old + 1] - self.at[old]
        ends = np.cumsum(size)
        begin[new], length[new] = len(self.ids) + ends - size, size
        self.used[old] = True
        short = pc.less_equal(pc.binary_length(fresh), SHORT).to_numpy(zero_copy_only=False)
        self.ids = np.concatenate((self.ids, spread(more, (ends - size)[short], size[short])))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(size[short])))
        self.known = pa.concat_arrays([self.known, fresh.filter(pa.array(short))])
        self.used = np.concatenate((self.used, np.zeros(int(short.sum()), bool)))
        if len(self.known) > REMEMBER:  # what hasn't come again since the last time goes
            keep, sizes = self.used, np.diff(self.at)
            if keep.sum() > REMEMBER // 2:
                self.forget()
            else:
                self.known, self.ids = self.known.filter(pa.array(keep)), spread(self.ids, self.at[:-1][keep], sizes[keep])
                self.at, self.used = np.concatenate(([0], np.cumsum(sizes[keep]))), np.zeros(int(keep.sum()), bool)
        return buffer, begin, length

    def encode_new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces (a space and a word each), one after the other, and how many each has.

        Many pieces are one input, for a cut before a space changes nothing; the marks of tokens tell where each begins or
        ends. Pieces of which that can't be told, and inputs whose marks are not as many as they should be, are encoded
        piece by piece.
        """
        n = len(words)
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        plain = (size > 0) & (size <= LONG) & ~pc.match_substring(words, "<").to_numpy(zero_copy_only=False)
        marks = plain.astype(np.int64)
        if self.closed:
            simple = ~pc.match_substring_regex(words, _OTHERS).to_numpy(zero_copy_only=False)
            letters = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
            count = pc.count_substring_regex(pc.utf8_lower(words), _WORDS).to_numpy(zero_copy_only=False)
            marks = np.where(simple, count, 1) * plain
            plain &= simple | letters
        rows = np.flatnonzero(plain)
        bounds = np.append(np.arange(0, len(rows), TOGETHER), len(rows))
        lists = pa.LargeListArray.from_arrays(pa.array(bounds), words.take(pa.array(rows)))
        texts = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist() if len(rows) else []
        alone = list(np.flatnonzero(~plain))
        pieces_ids: list[np.ndarray] = []
        begin, length, used = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for at in range(0, len(texts), 16):
            for k, e in enumerate(self.tokenizer.encode_batch_fast([f" {t}" for t in texts[at : at + 16]], add_special_tokens=False), at):
                mine = rows[bounds[k] : bounds[k + 1]]
                ids = np.array(e.ids, np.uint32)
                marked, upto = np.flatnonzero(self.marks[ids]), np.concatenate(([0], np.cumsum(marks[mine])))
                if len(marked) != upto[-1] or not len(marked) or (marked[-1] != len(ids) - 1 if self.closed else marked[0] != 0):
                    alone += list(mine)
                    continue
                edge = np.concatenate(([0], marked + 1))[upto] if self.closed else np.append(marked, len(ids))[upto]
                begin[mine], length[mine] = used + edge[:-1], np.diff(edge)
                pieces_ids.append(ids)
                used += len(ids)
        if alone:
            some = words.take(pa.array(np.array(alone, np.int64))).to_pylist()
            cells = self.alone([f" {w}" for w in some])
            for r, ids in zip(alone, cells, strict=True):
                begin[r], length[r] = used, len(ids)
                pieces_ids.append(ids)
                used += len(ids)
        flat = np.concatenate(pieces_ids) if pieces_ids else np.zeros(0, np.uint32)
        return spread(flat, begin, length), length

    def alone(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of pieces, each an input of its own; long ones are cut where that is safe, and what stays long is a tree."""
        parts = [[p] if len(p) <= LONG or "\x00" in p else self.cut(p) for p in pieces]
        each = list(dict.fromkeys(chain.from_iterable(parts)))
        known: dict[str, np.ndarray] = {p: np.array(self.tree(p), np.uint32) for p in each if len(p) > LONG}
        each = [p for p in each if len(p) <= LONG]
        for at in range(0, len(each), 20_000):
            some = each[at : at + 20_000]
            known.update((p, np.array(e.ids, np.uint32)) for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True))
        return [known[part[0]] if len(part) == 1 else np.concatenate([known[p] for p in part] or [np.zeros(0, np.uint32)]) for part in parts]

    def cut(self, text: str) -> list[str]:
        """The pieces of a text, one string at a time."""
        return [p for p in _SAFE.split(text) if p] if text else []

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the offsets of each text in it (n + 1)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.or_(pc.match_substring_regex(texts, _UNSAFE_SPACE), pc.match_substring(texts, "\x00")).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        lists = pc.split_pattern(plain, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        flat = lists.flatten().dictionary_encode()
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        code, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
        size = len(words)
        # The first piece of a text has no space before it: it gets a number of its own.
        first = at[:-1][np.diff(at) > 0]
        heads, numbers = np.unique(code[first], return_inverse=True) if len(first) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        code[first] = size + numbers
        others = words.take(pa.array(heads)).to_pylist()
        rows = np.flatnonzero(odd)
        if len(rows):  # texts that need each cut looked at: a piece list of their own
            own = [[t] if "\x00" in t else self.cut(t) for t in texts.take(pa.array(rows)).to_pylist()]
            number = dict.fromkeys(chain.from_iterable(own))
            letters = [p for p in number if p[0] == " " and p[1:].isalpha() and len(p) <= LONG]
            number.update((p, size + k) for k, p in enumerate(letters))
            rest = [p for p, k in number.items() if k is None]
            code[first] += len(letters)
            number.update((p, size + len(letters) + len(others) + k) for k, p in enumerate(rest))
            # Words that both kinds of texts have are one for the memory.
            extra = pa.array([p[1:] for p in letters], pa.large_string())
            others += rest
            split = np.split(code, at[1:-1])
            for r, ps in zip(rows, own, strict=True):
                split[r] = np.fromiter((number[p] for p in ps), np.int64, len(ps))
            at = np.concatenate(([0], np.cumsum([len(x) for x in split])))
            code = np.concatenate(split) if split else code
            both = pa.concat_arrays([words, extra]).dictionary_encode()
            same, words = both.indices.to_numpy(zero_copy_only=False), both.dictionary
        else:
            same = np.arange(size)
        buffer, begin, length = self.look(words)
        begin, length = begin[same], length[same]
        # Each distinct piece is encoded once.
        cells = self.alone(others)
        tail = np.fromiter(map(len, cells), np.int64, len(cells))
        begin = np.concatenate((begin, len(buffer) + np.cumsum(tail) - tail))
        length = np.concatenate((length, tail))
        buffer = np.concatenate([buffer, *cells])
        size = length[code]
        return spread(buffer, begin[code], size), np.concatenate(([0], np.cumsum(size)))[at]

    # -- tree concatenation -----------------------------------------------------------------------------------------
    def tree(self, text: str) -> list[int]:
        """Ids of a long text: its halves in two threads (the library lets others run meanwhile), then joins level by level."""
        bounds = [*range(0, len(text), LEAF), len(text)]
        spans = [(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if a < b]
        half = len(spans) // 2
        encode = lambda part: self.tokenizer.encode_batch([text[a:b] for a, b in part], add_special_tokens=False)
        with ThreadPoolExecutor(2) as pool:
            leaves = list(chain.from_iterable(pool.map(encode, (spans[:half], spans[half:]))))
            nodes = [(a, b, *self._of(e, a)) for (a, b), e in zip(spans, leaves, strict=True)]
            while len(nodes) > 1:
                joined = list(pool.map(lambda pair: self._join(text, *pair), zip(nodes[::2], nodes[1::2], strict=False)))
                nodes = joined + ([nodes[-1]] if len(nodes) % 2 else [])
        return nodes[0][2] if nodes else []

    @staticmethod
    def _of(encoding, base: int) -> tuple[list[int], list[tuple[int, int]]]:
        return encoding.ids, [(a + base, b + base) for a, b in encoding.offsets]

    def _join(self, text: str, x: tuple, y: tuple) -> tuple:
        (start, middle, left, left_at), (_, end, right, right_at) = x, y
        reach = WINDOW
        while True:
            low, high = max(start, middle - reach), min(end, middle + reach)
            while low > start and not _clean(text, low):
                low -= 1
            ids, at = self._of(self.tokenizer.encode(text[low:high], add_special_tokens=False), low)
            if low == start and high == end:
                return start, end, ids, at
            where = {span: k for k, span in enumerate(at)}
            a = (0, 0) if low == start else self._agree(left, left_at, ids, where, middle - reach, middle - 16, True)
            b = (len(right), len(ids)) if high == end else self._agree(right, right_at, ids, where, middle + 16, middle + reach - 32, False)
            if a is not None and b is not None and a[1] <= b[1]:
                return start, end, left[: a[0]] + ids[a[1] : b[1]] + right[b[0] :], left_at[: a[0]] + at[a[1] : b[1]] + right_at[b[0] :]
            reach *= 2

    @staticmethod
    def _agree(side: list, side_at: list, ids: list, where: dict, low: int, high: int, last: bool):
        """A place (token of the side, token of the window) amid AGREE equal tokens in a row, between the characters low and high."""
        found, run = None, 0
        from bisect import bisect_left

        k = bisect_left(side_at, (low, low))
        while k < len(side) and side_at[k][1] <= high:
            w = where.get(side_at[k])
            clean = k > 0 and side_at[k - 1][1] <= side_at[k][0]
            run = run + 1 if w is not None and ids[w] == side[k] and (run == 0 or where.get(side_at[k - 1]) == w - 1) else 0
            if run >= AGREE and clean:
                found = (k - 1, w - 1)
                if not last:
                    break
            k += 1
        return found


def _clean(text: str, at: int) -> bool:
    """A window may start here: no white space, apostrophe, mark or conjoining letter nearby that the start would change."""
    c = text[at]
    return not (c.isspace() or text[at - 1].isspace() or "'" in text[max(0, at - 4) : at + 4] or unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ")


def spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices values[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return values[:0]
    out, a = np.empty(total, values.dtype), 0
    while a < len(ends):  # places take eight bytes a value, so only those of about SPAN values are there at a time
        base = int(ends[a - 1]) if a else 0
        z = max(a + 1, int(np.searchsorted(ends, base + SPAN, side="right")))
        to = int(ends[z - 1])
        if z == a + 1:
            out[base:to] = values[int(starts[a]) : int(starts[a]) + to - base]
        else:
            step = np.repeat((starts[a:z] - (ends[a:z] - lengths[a:z])).astype(np.int64, copy=False), lengths[a:z])
            step += np.arange(base, to)
            out[base:to] = values[step]
        a = z
    return out


class Decoder:
    """Byte-level decoding by table: the bytes of each id, laid end to end."""

    _open: dict = {}

    def __init__(self, path: str):
        # The byte alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        vocab = Encoder.of(path).tokenizer.get_vocab(with_added_tokens=True)
        table = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            table[i] = bytes(byte[c] for c in token)
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        # Numbers of four bytes, for there is one for each id of a part.
        self.sizes = np.fromiter(map(len, table), np.int32, len(table))
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)

    @classmethod
    def of(cls, path: str) -> Decoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, and the offsets of each text."""
        size = self.sizes[ids]
        at = np.concatenate(([0], np.cumsum(size)))
        return spread(self.bytes, self.starts[ids], size), at[offsets]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again: id, n_tokens, ids_sha256, decoded_sha256; keep_ids adds the ids.

    One pass without a shuffle. A text whose decoded bytes are not its own raises an error.
    """
    fields = docs.schema
    schema = f"{id_col} {fields[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder.of(vocabulary), Decoder.of(vocabulary)
        for batch in batches:
            for part in slices(batch, text_col, PART):
                ids, at = encoder.encode(part.column(1))
                data, to = decoder.decode(ids, at)
                raw, text = memoryview(ids.astype("<u4", copy=False).view(np.uint8)), memoryview(data)
                said = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                back = [_digest(text[a:b]) for a, b in zip(to[:-1], to[1:], strict=True)]
                out = [part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(said), pa.array(back)]
                if keep_ids:
                    out.append(pa.array([bytes(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()))
                del ids, data, raw, text  # else they stay while the next part is encoded
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _digest(text: memoryview) -> str:
    """Of the text as the library gives it: bytes that are no UTF-8 are replaced."""
    data = bytes(text)
    try:
        data.decode()
    except UnicodeDecodeError:
        data = data.decode(errors="replace").encode()
    return hashlib.sha256(data).hexdigest()


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document with the public 50k byte-level vocabulary."""
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


QUERIES = {"op2_bpe": op2_bpe}
ORACLE: dict[str, str] = {}
