"""BPE encoding and decoding by tree concatenation.

``encode`` turns each text into the ids that the tokenizers library gives for
the same file with add_special_tokens=False; ``decode`` turns ids into the
library's decode(ids, skip_special_tokens=False).

A text is cut into leaves. Where the cut falls beside white space, or between
two characters that no pre-token spans, the parts' ids simply follow each
other. Where it has to fall inside a long run without any such place, the run's
parts are encoded apart, on different tasks, and joined pairwise in a tree:
a window of tokens around the join is encoded anew, and grows until its first
and last token equal those already there. That is exact for BPE: a sequence of
tokens is the encoding of its text if each neighbouring pair is the encoding of
its own text, and both ends of an agreeing window keep their old neighbours.

A run of over ``RUN`` characters is cut in halves and joined in the same way
inside a leaf, so ordinary long words go through the tree as well.

Within a leaf, texts are split into runs of letters, of punctuation, and digits
by array operations; equal runs are found by hashes and compared character by
character. A run is encoded once per worker while its memo lasts; the memo's
size is bounded and does not change results. Chunks with any other character
(a contraction, a mark, a script beyond Latin-1) go to the library whole.

Defined results: null text is encoded as the empty text, which has no ids;
repeated rows (ids too) give a result each; other columns stay out of the work
unless named in ``keep``; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import string
import sys
import unicodedata
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, released
from .spans import hashes, rolling, within

#: Characters of a leaf; longer texts are encoded on several tasks.
LEAF = 1 << 16
#: Characters of a run above which it is encoded by halves inside a leaf, too; characters of other chunks above which they are.
RUN, CHUNK = 16, 1 << 12
#: Runs, and characters of runs, of a worker's memo, and its slots; characters of texts that are split at a time.
MEMO, MEMO_CHARS, SLOTS, BUFFER = 300_000, 1 << 22, 1 << 20, 1 << 18
#: Kinds of characters: separators, letters that no normaliser changes but for their case, digits, ASCII punctuation without an apostrophe, others.
SEPARATOR, LETTER, DIGIT, MARK, OTHER = range(5)
#: Characters of decoded text that are held at a time.
SLICE = 1 << 22
#: Tokens on each side of a join that are first encoded anew.
WINDOW = 4


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _kind(c: str) -> str:
    if c.isspace():
        return "S"
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "O"


class Encoder:
    """Encodes texts with one tokenizer file. Holds a bounded memo; one per Python worker."""

    def __init__(self, path: str, memo: int = MEMO, run: int = RUN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.path, self.limit, self.run, self.joins = path, memo, run, 0
        self.suffix = self.spec["model"].get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in self.spec["added_tokens"]]
        self.cuts = self._cuts()
        letters = [c for c in map(chr, range(0xC0, 0x100)) if c.isalpha()]
        self.kinds, self.folded = _tables(letters)
        self._forget()
        self.mapped = {ord(c): "".join(p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(c)) for c in letters} if self.cuts else {}
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self._models = self.spec = None  # the vocabulary and merges are read again if a long run needs them

    def _cuts(self) -> bool:
        """Whether the file's steps are those for which cutting at white space is known to be exact."""
        s = self.spec
        norm = [(n["type"], n.get("pattern"), n.get("content")) for n in (s.get("normalizer") or {}).get("normalizers", [])]
        pre = (s.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            norm == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and [p["type"] for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
            and pre[0]["behavior"] == "Removed"
            and pre[0]["invert"]
            and not pre[1]["add_prefix_space"]
            and not pre[1]["use_regex"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in s["added_tokens"])
            and not s.get("post_processor")
            and s["model"]["type"] == "BPE"
            and s["model"]["dropout"] is None
        )

    def _batch(self, texts: list[str]) -> list:
        return getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)(texts, add_special_tokens=False) if texts else []

    def _library(self, texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in self._batch(texts)]

    # -- joins -------------------------------------------------------------

    @property
    def models(self):
        """The file's model without and with the mark of a word's end."""
        if self._models is None:
            from tokenizers.models import BPE

            with open(self.path, encoding="utf-8") as f:
                m = json.load(f)["model"]
            merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
            self._models = BPE(vocab=m["vocab"], merges=merges), self.tok.model
            self.name = {i: t for t, i in m["vocab"].items()}
        return self._models

    def _tokens(self, mapped: str, closed: bool) -> list[int]:
        return [t.id for t in self.models[closed].tokenize(mapped)] if mapped else []

    def _ends(self, token: int) -> bool:
        return token not in self.name or bool(self.suffix) and self.name[token].endswith(self.suffix)

    def join(self, a: list[int], b: list[int], closed: bool | None = None) -> list[int]:
        """The ids of two texts put together, where a ends and b begins inside one run of characters.

        closed: whether the run ends with b; None: see the tokens of b.
        """
        self.models
        self.joins += 1
        left = 0
        while left < len(a) and not self._ends(a[-1 - left]):
            left += 1
        right = 0
        while right < len(b) and not self._ends(b[right]):
            right += 1
        if right < len(b) and b[right] in self.name:
            right += 1
        if not left or not right:
            return a + b
        k = WINDOW
        while True:
            x, y = min(k, left), min(k, right)
            old = a[len(a) - x :] + b[:y]
            ends = self._ends(b[y - 1])
            text = "".join(self.name[t] for t in old)
            new = self._tokens(text[: len(text) - len(self.suffix)] if ends else text, ends)
            if (x == left or new[0] == old[0]) and (y == right or new[-1] == old[-1]):
                return a[: len(a) - x] + new + b[y:]
            k *= 2

    def tree(self, parts: list[list[int]], hard: list[bool]) -> list[int]:
        """Ids of consecutive parts put together by halves; hard[i]: the cut after part i is inside a run."""
        if len(parts) == 1:
            return parts[0]
        m = len(parts) // 2
        a, b = self.tree(parts[:m], hard[: m - 1]), self.tree(parts[m:], hard[m:])
        return self.join(a, b) if hard[m - 1] else a + b

    # -- cuts --------------------------------------------------------------

    def _hard(self, text: str, i: int) -> bool | None:
        """Whether a cut before text[i] is inside a run; None if no cut may be made there."""
        c, d = text[i - 1], text[i]
        k = _kind(c), _kind(d)
        if k[1] == "S" and d in " \n" or k[0] == "S" and c in " \n":
            return False
        if "S" in k or any(unicodedata.category(x)[0] == "M" or "\u1100" <= x <= "\u11ff" for x in (c, d)):
            return None  # marks and conjoining letters may become one character with what stands before
        if "'" in text[max(0, i - 4) : i + 4] or "<|" in text[max(0, i - 24) : i + 24]:
            return None
        n = unicodedata.normalize
        if n("NFC", c + d) != c + d or len(c.lower()) > 1 or len(d.lower()) > 1 or any(s in text[max(0, i - len(s)) : i + len(s)] for s in self.specials):
            return None
        return k[0] == k[1] and k[0] != "N"

    def leaves(self, text: str, size: int = LEAF) -> Iterator[tuple[str, bool]]:
        """Consecutive parts of about that many characters, with whether the cut after each is inside a run."""
        at, n = 0, len(text)
        while n - at > size:
            end = at + size
            i = max(text.rfind(" ", at + size // 2, end), text.rfind("\n", at + size // 2, end))
            hard = None
            if i > at:
                hard = False
            else:
                i = end
                while i < n and (hard := self._hard(text, i)) is None:
                    i += 1
                if i >= n:
                    break
            yield text[at:i], hard
            at = i
        yield text[at:], False

    def leaf(self, text: str, open_right: bool) -> list[int]:
        """Ids of a leaf; open_right: its last run goes on in the next leaf, so no word ends with it."""
        import numpy as np

        if not open_right:
            return np.frombuffer(self.encode([text])[0], dtype="<u4").tolist()
        i = max(text.rfind(" "), text.rfind("\n")) + 1
        head = np.frombuffer(self.encode([text[:i]])[0], dtype="<u4").tolist() if i else []
        return head + self._chunk(text[i:], False)

    def _chunk(self, chunk: str, closed: bool) -> list[int]:
        """Ids of a chunk without white space, piece by piece; closed: whether its last run ends with it."""
        ids: list[int] = []
        by = "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))
        parts = [p for p in (re.split(f"({by})", chunk) if by else [chunk]) if p]
        for n, part in enumerate(parts, 1):
            if part in self.specials:
                ids.append(self.tok.token_to_id(part))
                continue
            pieces = [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))]
            for m, p in enumerate(pieces, 1):
                ids += self._halves(p, closed or n < len(parts) or m < len(pieces))
        return ids

    def _halves(self, mapped: str, closed: bool) -> list[int]:
        if len(mapped) <= self.run:
            return self._tokens(mapped, closed)
        m = len(mapped) // 2
        return self.join(self._halves(mapped[:m], False), self._halves(mapped[m:], closed))

    # -- whole texts -------------------------------------------------------

    def _forget(self) -> None:
        import numpy as np

        #: By the low bits of a run's hash: its hash, and its number (-1: none). A later run takes an earlier one's slot.
        self.keys, self.numbers = np.zeros(SLOTS, "u8"), np.full(SLOTS, -1, "i4")
        #: The runs' characters and ids, run after run; by number where a run's begin, and how many they are.
        self.chars, self.char_at, self.char_n = _Pool("<u4"), _Pool("i8"), _Pool("i8")
        self.pool, self.at, self.many = _Pool("<u4"), _Pool("i8"), _Pool("i8")

    def _known(self, keys, text, starts, sizes):
        """Numbers of runs of text, -1 for those the memo does not have."""
        import numpy as np

        slot = (keys & np.uint64(SLOTS - 1)).astype("i8")
        number = np.where(self.keys[slot] == keys, self.numbers[slot], -1).astype("i8")
        number[number >= 0] = np.where(self.char_n[number[number >= 0]] == sizes[number >= 0], number[number >= 0], -1)
        have = np.flatnonzero(number >= 0)
        n = sizes[have]
        differ = text[within(starts[have], n)] != self.chars[within(self.char_at[number[have]], n)]
        if differ.any():  # another run of the same hash
            number[have[np.repeat(np.arange(len(have)), n)[differ]]] = -1
        return number

    def _learn(self, runs: list[str], odd: list[bool]):
        """Ids of runs, one after the other, and how many each has."""
        import numpy as np

        tokenize, mapped, run = self.tok.model.tokenize, self.mapped, self.run
        got: list[list[int] | None] = []
        for w, other in zip(runs, odd, strict=True):
            if other:
                got.append(self._chunk(w, True) if len(w) > CHUNK else None)
            else:  # a run is one pre-token, so the model alone does
                w = w if w.isascii() else w.translate(mapped)
                got.append([t.id for t in tokenize(w)] if len(w) <= run else self._halves(w, True))
        short = [i for i, x in enumerate(got) if x is None]
        for i, e in zip(short, self._batch([runs[i] for i in short]), strict=True):
            got[i] = e.ids
        many = np.fromiter(map(len, got), "i8", len(got))
        return np.fromiter(itertools.chain.from_iterable(got), "<u4", int(many.sum())), many

    def _split(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        import numpy as np

        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        if len(self.at) > self.limit or len(self.chars) > MEMO_CHARS:
            self._forget()
        kind = self.kinds[np.minimum(codes, 256)]
        inside = kind != SEPARATOR
        before = np.concatenate(([SEPARATOR], kind[:-1])).astype(kind.dtype)
        starts = inside & (before == SEPARATOR)
        odd = np.zeros(len(codes), "?")
        if (kind == OTHER).any():  # of a chunk with such a character all is one run
            of = np.cumsum(starts) - 1
            odd[inside] = (np.bincount(of[kind == OTHER], minlength=int(starts.sum())) > 0)[of[inside]]
        starts |= inside & ~odd & ((kind != before) | (kind == DIGIT))
        text = np.where(odd | (codes > 255), codes, self.folded[np.minimum(codes, 255)]).astype("<u4", copy=False)
        last = inside & np.concatenate((starts[1:] | ~inside[1:], [True]))[: len(codes)]
        s, e = np.flatnonzero(starts), np.flatnonzero(last) + 1
        keys, first, where = np.unique(hashes(rolling(text), s, e), return_index=True, return_inverse=True)
        size, chars = e - s, text[inside]
        if (size != size[first][where]).any() or (chars != text[within(s[first][where], size)]).any():  # two runs with one hash
            return [_bytes(x.ids) for x in self._batch(texts)]
        from_, n = s[first], size[first]
        number = self._known(keys, text, from_, n)
        new = np.flatnonzero(number < 0)
        if len(new):
            whole = text.tobytes().decode("utf-32-le", "surrogatepass")
            ids, many = self._learn([whole[a:b] for a, b in zip(from_[new].tolist(), (from_ + n)[new].tolist(), strict=True)], odd[from_[new]].tolist())
            number[new] = np.arange(len(self.at), len(self.at) + len(new))
            self.at.add(len(self.pool) + np.cumsum(many) - many)
            self.many.add(many)
            self.pool.add(ids)
            self.char_at.add(len(self.chars) + np.cumsum(n[new]) - n[new])
            self.char_n.add(n[new])
            self.chars.add(text[within(from_[new], n[new])])
            slot = (keys[new] & np.uint64(SLOTS - 1)).astype("i8")
            self.keys[slot], self.numbers[slot] = keys[new], number[new]
        of = number[where]
        many = self.many[of]
        ids = self.pool[within(self.at[of], many)]
        bounds = np.cumsum(np.fromiter(map(len, texts), "i8", len(texts)) + 1)
        ends = np.concatenate(([0], np.cumsum(many)))[np.searchsorted(s, bounds)]
        return [x.tobytes() for x in np.split(ids, ends[:-1])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian 32-bit numbers."""
        if not self.cuts:
            return self._library(texts)
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for t in texts:
            special = self.special and self.special.search(t)
            if part and (special or size + len(t) > BUFFER):
                out += self._split(part)
                part, size = [], 0
            if special:
                out += self._library([t])
            else:
                part.append(t)
                size += len(t)
        return out + (self._split(part) if part else [])


def _tables(letters: list[str]):
    """(kinds, folded): by code point below 256 the kind of a character and its lower case; kinds has one more, for all others."""
    import numpy as np

    kinds, folded = np.full(257, OTHER, "i1"), np.arange(256, dtype="<u4")
    kinds[33:127] = MARK
    kinds[ord("'")] = OTHER
    kinds[[ord(" "), ord("\n")]] = SEPARATOR
    kinds[ord("0") : ord("9") + 1] = DIGIT
    for c in (*string.ascii_letters, *letters):
        kinds[ord(c)], folded[ord(c)] = LETTER, ord(c.lower())
    return kinds, folded


class _Pool:
    """An array that grows at its end."""

    def __init__(self, kind: str):
        import numpy as np

        self.room, self.n = np.zeros(1 << 14, kind), 0

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i):
        return self.room[i]

    def add(self, more) -> None:
        import numpy as np

        n = self.n + len(more)
        if n > len(self.room):
            self.room = np.concatenate([self.room, np.zeros(max(n - len(self.room), len(self.room)), self.room.dtype)])
        self.room[self.n : n], self.n = more, n


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _batches(column, most: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """Slices of an Arrow column of texts, of bounded size."""
    at, part, size = 0, [], 0
    for i, x in enumerate(column):
        part.append(x.as_py() or "")
        size += len(part[-1])
        if size > most:
            yield at, part
            at, part, size = i + 1, [], 0
    if part:
        yield at, part


class Decoder:
    """Texts of ids, as the library's decode gives them with special tokens kept."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            plain = json.load(f).get("decoder") is None
        self.tok = Tokenizer.from_file(path)
        self.known = np.array([self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size(with_added_tokens=True))], dtype=object)
        self.joins = plain and None not in self.known

    def text(self, ids) -> str:
        """ids: an array of integers. Without a decoder in the file the library puts a space between tokens."""
        return " ".join(self.known[ids].tolist()) if self.joins else self.tok.decode(ids.tolist(), skip_special_tokens=False)


_decoders: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders.clear()
        _decoders[path] = Decoder(path)
    return _decoders[path]


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, packed: bool = False, decoded: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The columns named in keep and ``ids``: array<int>, or little-endian 32-bit numbers as binary if packed.

    decoded: name of a further column with the ids' text again, made in the same pass.
    """
    path = path or default_path()
    kept = [docs[c].alias(f"k{i}") for i, c in enumerate(keep)]
    base = docs.select(*kept, docs[text].alias("x"))
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    made = T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType()))

    def arrow(ids: list[bytes]):
        import numpy as np
        import pyarrow as pa

        if packed:
            return pa.array(ids, pa.binary())
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype="int32")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))

    def whole(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(path)
        for b in batches:
            for at, part in _batches(b.column("x")):
                rest = b.drop_columns(["x"]).slice(at, len(part))
                ids = enc.encode(part)
                back = [pa.array([decoder(path).text(np.frombuffer(x, dtype="<u4")) for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*rest.columns, arrow(ids), *back], names=[*rest.schema.names, "ids", *["decoded"] * len(back)])
        if enc.cuts:
            enc._forget()  # an idle worker keeps no memo

    def cut(frames):
        import pyarrow as pa

        enc = encoder(path)
        for b in frames:
            for row, t in zip(b.column("row").to_pylist(), b.column("x").to_pylist(), strict=True):
                for n, (part, hard) in enumerate(enc.leaves(t, leaf) if enc.cuts else [(t, False)]):
                    yield pa.RecordBatch.from_pydict({"row": [row], "n": pa.array([n], pa.int32()), "part": [part], "hard": [hard]})

    def parts(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(path)
        for b in batches:
            got = [np.array(enc.leaf(p, h), dtype="<u4").tobytes() for p, h in zip(b.column("part").to_pylist(), b.column("hard").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n"), b.column("hard"), pa.array(got, pa.binary())], names=["row", "n", "hard", "part_ids"])

    def joined(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("n")
        ids = encoder(path).tree([np.frombuffer(x, dtype="<u4").tolist() for x in pdf.part_ids], pdf.hard.tolist()[:-1])
        return pd.DataFrame({"row": pdf.row.iloc[:1], "joined": [np.array(ids, dtype="<u4").tobytes()]})

    long = F.length("x") > leaf
    short = base.where(~F.coalesce(long, F.lit(False))).mapInArrow(released(whole), T.StructType([*fields, made, *[T.StructField("decoded", T.StringType())] * bool(decoded)]))
    rows = numbered(base.where(long), "row")
    leaves = rows.select("row", "x").mapInArrow(cut, "row long, n int, part string, hard boolean").repartition("row", "n")
    whole_ids = leaves.mapInArrow(released(parts), "row long, n int, hard boolean, part_ids binary").groupBy("row").applyInPandas(joined, "row long, joined binary")
    if not packed:
        whole_ids = whole_ids.mapInArrow(
            lambda bs: (__import__("pyarrow").RecordBatch.from_arrays([b.column("row"), arrow(b.column("joined").to_pylist())], names=["row", "joined"]) for b in bs), "row long, joined array<int>"
        )
    names = [f"k{i}" for i in range(len(keep))]
    tall = rows.drop("x").join(whole_ids, "row").select(*names, F.col("joined").alias("ids"))
    if decoded:
        tall = decode(tall, "ids", path, "decoded", packed)
    return short.union(tall).toDF(*keep, "ids", *[decoded] * bool(decoded))


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None, name: str = "decoded", packed: bool = False) -> DataFrame:
    """encoded with the text of its ids added; null ids give null. packed: ids are binary, as encode() packs them."""
    path = path or default_path()
    names = [c for c in encoded.columns if c != name]
    schema = T.StructType([*(encoded.schema[c] for c in names), T.StructField(name, T.StringType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        dec = decoder(path)
        for b in batches:
            rows, out, size, at = b.column(ids), [], 0, 0
            for i, x in enumerate(rows, 1):
                if not x.is_valid:
                    out.append(None)
                elif packed:
                    out.append(dec.text(np.frombuffer(x.as_py(), dtype="<u4")))
                else:
                    out.append(dec.text(x.values.to_numpy(zero_copy_only=False)))
                size += len(out[-1] or "")
                if size > SLICE or i == len(rows):  # a bounded amount of text at a time
                    rest = b.select(names).slice(at, len(out))
                    yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.string())], names=[*names, name])
                    out, size, at = [], 0, i

    return encoded.mapInArrow(run, schema)
