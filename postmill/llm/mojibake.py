"""Garbled text from wrong character encoding: find it and restore it.

1. Corpus statistics: the adjacent character pairs of every different sentence are counted, each sentence
   once, so that garbling does not become normal by being repeated (in two tables of PAIR_SLOTS hashed slots, of
   which the lesser count holds, so what is sent to the executors has a fixed bound), and with them each pair's
   share of the corpus' mutual information, p(xy) log(p(xy) / p(x)p(y)).
2. Improbable runs: pairs with a non-ASCII character that carry less than a threshold of that information
   score positive, other pairs and distance negative; the maximum-scoring segments are the runs. A stretch
   that an inverse mapping makes more probable is improbable whatever its information.
3. Only inside the runs inverse mappings are tested. A text that was UTF-8 shows byte groups of UTF-8 spelled
   in the wrong encoding; chains of such groups are replaced. A text of a one-byte encoding read as another
   is mapped where runs reach into its sentences; the sentence judges the mapping. A mapping is kept if the pairs of the result are more probable in the
   corpus, by either count. Layers are taken off until nothing improves. Where only characters that stand alone would change
   ("named Ð or Ñ"), counts with repetitions decide, unless other sentences show the same mapping.

A garbled token that stands beside its own clean form in one sentence is a quotation and stays.

Edge cases: null, empty and pure ASCII texts are never found; U+FFFD, the mark of a failed decoding, is a run of its
own without inverse, so a text with it is found, but not restored (the result is null); repeated rows give equal results; empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import spread

#: each pair of characters has one slot in each of two tables; the lesser of its counts holds
PAIR_SLOTS, TABLES = 1 << 21, 2
REPLACEMENT = "�"
#: encodings that UTF-8 bytes are read as by mistake
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman", "cp850")
#: (written in, read as) of one-byte encodings
SINGLE = (("cp1251", "cp1252"), ("cp1251", "latin-1"), ("cp1250", "cp1252"), ("cp1250", "latin-1"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"))
#: for Spark: a piece begins with the white space that parts it from the one before, so no non-ASCII pair is lost
PIECES = r"(?=\n)|(?<=[.!?])(?=\s)"
SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?]+(?=\s|$)|[.!?](?!\s)[^\n.!?]*)*[.!?]*\s*|\n")
#: share of the corpus' characters from which on one is known
KNOWN = 8e-8
NON_ASCII = re.compile(r"[^\x00-\x7f]+")


def byte_chars(encoding: str) -> list[str]:
    """What each byte is read as; bytes that the encoding leaves undefined stay control characters."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


class Utf8ReadAs:
    """Finds chains of UTF-8 byte groups spelled in an encoding."""

    def __init__(self, encoding: str):
        chars = byte_chars(encoding)
        self.to_byte = {c: b for b, c in enumerate(chars) if b > 127}
        for b in range(0x80, 0xA0):  # also where an undefined or defined byte was kept as a control
            self.to_byte.setdefault(chr(b), b)
        by = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in self.to_byte.items() if lo <= b <= hi) + "]"
        tail = by(0x80, 0xBF)
        self.chain = re.compile(f"(?:{by(0xC2, 0xDF)}{tail}|{by(0xE0, 0xEF)}{tail}{{2}}|{by(0xF0, 0xF4)}{tail}{{3}})+")

    def restore(self, chain: str) -> str | None:
        try:
            return bytes(self.to_byte[c] for c in chain).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return None


class OneByte:
    """Maps text of one one-byte encoding that was read as another."""

    def __init__(self, written: str, read: str):
        right, wrong = byte_chars(written), byte_chars(read)
        self.table = {ord(wrong[b]): right[b] for b in range(128, 256) if not (0x80 <= ord(right[b]) < 0xA0)}
        for b in range(0x80, 0xA0):
            if not (0x80 <= ord(right[b]) < 0xA0):
                self.table.setdefault(b, right[b])

        self.other = re.compile("[^\x00-\x7f" + "".join(re.escape(chr(c)) for c in self.table) + "]")

    def restore(self, text: str) -> str | None:
        if self.other.search(text):
            return None
        out = text.translate(self.table)
        return out if out != text else None


def slots(x, y):
    """The slots of a pair of code points in the tables; also of arrays of them."""
    a = x * 0x9E3779B1 + y * 0x85EBCA77 + (x ^ (y << 7))
    b = (x * 0xC2B2AE35 ^ (y * 0x27D4EB2F)) + (y << 11)
    return a & (PAIR_SLOTS - 1), ((b ^ (b >> 17)) & (PAIR_SLOTS - 1)) + PAIR_SLOTS


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, code, n): pair slots (0), characters (1) and the number of pairs (2) of a partition's texts; where
    a column n says how often each text occurs, the same with repetitions (3, 4, 5)."""
    size = PAIR_SLOTS * TABLES
    pairs, chars, total = np.zeros((2, size), np.int64), np.zeros((2, 0x110000), np.int64), [0, 0]
    repeated = False
    for batch in batches:
        repeated = "n" in batch.schema.names
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            texts = part.column("text").to_pylist()
            # texts are set apart by line feeds
            joined = "\n".join(t for t in texts if t)
            c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            if len(c) < 2:
                continue
            x, y = c[:-1], c[1:]
            some = np.flatnonzero((x > 127) | (y > 127))
            own = np.bincount(c)
            chars[0, : len(own)] += own
            total[0] += len(x)
            # the tables are large beside what a few texts have
            different, which = np.unique(np.concatenate(slots(x[some], y[some])), return_inverse=True)
            pairs[0, different] += np.bincount(which, minlength=len(different))
            if repeated:
                times = np.repeat([n for t, n in zip(texts, part.column("n").to_pylist()) if t], [len(t) + 1 for t in texts if t])[:-1]
                chars[1, : len(own)] += np.bincount(c, times).astype(np.int64)
                total[1] += int(times[:-1].sum())
                pairs[1, different] += np.bincount(which, np.tile(times[some], TABLES), minlength=len(different)).astype(np.int64)
    for k in (0, 1) if repeated else (0,):
        for kind, counts in ((0, pairs[k]), (1, chars[k])):
            codes = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), 3 * k + kind, np.int32)), pa.array(codes), pa.array(counts[codes])], names=["kind", "code", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([3 * k + 2], pa.int32()), pa.array([0]), pa.array([total[k]])], names=["kind", "code", "n"])


def corpus_statistics(docs: DataFrame, text: str) -> dict[str, np.ndarray]:
    """Counts over all different sentences, and with repetitions ("all_"), as from ``statistics``; at most twice
    2 PAIR_SLOTS + 0x110000 numbers come to the driver, whatever the corpus."""
    pieces = docs.select(F.explode(F.split(F.col(text), PIECES)).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    return statistics(pieces.mapInArrow(_counts, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n")).toArrow())


def statistics(rows: pa.Table) -> dict[str, np.ndarray]:
    """Log frequencies of (kind, code, n): "pairs" and "chars", as slots or code points in order and their values."""
    kind, code, n = (rows.column(c).to_numpy() for c in ("kind", "code", "n"))
    out = {}
    for k, prefix in ((0, ""), (3, "all_")):
        total = max(int(n[kind == k + 2].sum()), 1)
        if k and not (kind == k + 2).any():
            break
        for name, of in (("pairs", k), ("chars", k + 1)):
            order = np.argsort(code[kind == of])
            out |= {prefix + name: code[kind == of][order].astype(np.int32), prefix + name + "_log": (np.log(n[kind == of][order]) - math.log(total)).astype(np.float32)}
        out[prefix + "total"] = np.array([total])
    return out


class _Cache(dict):
    """What a function gives for short strings, kept for a bounded number of them."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key: str):
        if len(key) > 64:
            return self.function(key)
        if len(self) > 200_000:
            self.clear()
        value = self[key] = self.function(key)
        return value


class Logs:
    """Log frequencies of pairs by slot, as sorted arrays: small beside the dictionary of a full table."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.codes, self.values = codes, values

    def get(self, x: int, y: int, default):
        found = None
        for s in slots(x, y):
            i = self.codes.searchsorted(s)
            if i == len(self.codes) or self.codes[i] != s:
                return default
            found = self.values[i] if found is None else min(found, self.values[i])
        return float(found)


class Model:
    """Pair and character statistics for scoring. Thresholds are shares of the corpus, so they hold at any size: of
    its mutual information (tau, rare) and of its characters, from which on one is known (known)."""

    def __init__(self, stats: dict[str, np.ndarray], tau: float = 1e-3, rare: float = 2e-5, known: float = KNOWN):
        every = "all_" if "all_total" in stats else ""
        self.pairs, self.all_pairs = (Logs(stats[e + "pairs"], stats[e + "pairs_log"]) for e in ("", every))
        self.chars = dict(zip(stats["chars"].tolist(), stats["chars_log"].tolist()))
        self.floor, self.all_floor = (-math.log(int(stats[e + "total"][0])) - 3.0 for e in ("", every))
        self.known = set(stats[every + "chars"][stats[every + "chars_log"] >= math.log(known)].tolist())
        self.tau, self.rare = tau, rare
        self.utf8 = [Utf8ReadAs(e) for e in READ_AS]
        self.single = [OneByte(w, r) for w, r in SINGLE]
        # what no inverse mapping can start from
        self.unmapped = re.compile("[^\x00-\x7f" + "".join(re.escape(chr(c)) for c in sorted({c for m in self.single for c in m.table})) + "]")
        self.leads = re.compile("[" + "".join(re.escape(c) for c in sorted({c for r in self.utf8 for c, b in r.to_byte.items() if 0xC2 <= b <= 0xF4})) + "]")
        self.log_p_of_all = _Cache(lambda pair: self.all_pairs.get(ord(pair[0]), ord(pair[1]), self.all_floor) if not pair.isascii() else 0.0)
        self.log_p = _Cache(lambda pair: self._pair(ord(pair[0]), ord(pair[1])))
        self.info = _Cache(lambda pair: self._information(ord(pair[0]), ord(pair[1])))
        self.gains = _Cache(self._gains)
        self.judged = _Cache(self._judged)

    def _pair(self, x: int, y: int) -> float:
        if x < 128 and y < 128:
            return 0.0
        return self.pairs.get(x, y, self.floor)

    def _information(self, x: int, y: int) -> float:
        """The pair's share of the corpus' mutual information."""
        p = self.pairs.get(x, y, None)
        if p is None:
            return 0.0
        return math.exp(p) * max(p - self.chars.get(x, self.floor) - self.chars.get(y, self.floor), 0.0)

    def familiar(self, text: str) -> bool:
        """All characters are known."""
        return all(c < "\x80" or ord(c) in self.known for c in set(text))

    def _judged(self, around: str) -> tuple[float, int, int]:
        """Of a stretch of non-ASCII characters with its neighbours: the score of its pairs, how many are rare,
        and how many there are."""
        if len(around) < 2:
            return 1.0, 1, 1
        values = [self.info[around[i : i + 2]] for i in range(len(around) - 1)]
        if self._better_one_byte(around):
            return float(len(values)), len(values), len(values)
        if self._better_utf8(around):
            return float(len(values)), sum([v < self.rare for v in values]), len(values)
        low = sum([v < self.tau for v in values])
        return low - 0.25 * (len(values) - low), sum([v < self.rare for v in values]), len(values)

    def _better_one_byte(self, around: str) -> bool:
        """A mapping makes known characters of the stretch and pairs that are e times as probable on average."""
        return max(self.gains[around]) > len(around) - 1

    def _gains(self, around: str) -> tuple[float, ...]:
        """What each one-byte mapping adds to the stretch's score; a sentence's gain is the sum of its stretches'."""
        if self.unmapped.search(around):
            return (-math.inf,) * len(self.single)
        own, out = self.score(around), []
        for m in self.single:
            new = None if m.other.search(around) else around.translate(m.table)
            out.append(self.score(new) - own if new is not None and self.familiar(new) else -math.inf)
        return tuple(out)

    def _better_utf8(self, around: str) -> bool:
        """Byte groups are in it, and without them its pairs are no less probable on average."""
        if not self.leads.search(around):
            return False
        own = self.score(around) / (len(around) - 1)
        for reader in self.utf8:
            if reader.chain.search(around):
                new = reader.chain.sub(lambda m: reader.restore(m.group()) or m.group(), around)
                if new != around and self.familiar(new) and self.score(new) >= own * max(len(new) - 1, 1):
                    return True
        return False

    def score(self, text: str) -> float:
        """Log probability of the pairs with a non-ASCII character."""
        log_p = self.log_p
        return sum([log_p[text[i : i + 2]] for i in range(len(text) - 1)])

    def score_of_all(self, text: str) -> float:
        """The same by counts with repetitions."""
        log_p = self.log_p_of_all
        return sum([log_p[text[i : i + 2]] for i in range(len(text) - 1)])


def maximal_segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximum-scoring segments [a, b) of a row of scores, in linear time (Ruzzo and Tompa)."""
    stack: list[list[float]] = []  # start, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        total += s
        if s <= 0:
            continue
        new = [i, i + 1, total - s, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(int(a), int(b)) for a, b, _, _ in stack]


@dataclass
class Stretches:
    """The non-ASCII stretches of a text as judged, and the runs that they form."""

    spans: list[tuple[int, int]]
    judged: list[tuple[float, int, int]]
    runs: list[tuple[int, int]]


def improbable_runs(text: str, model: Model) -> Stretches:
    """Spans of the maximum-scoring segments of improbable pairs."""
    spans = [m.span() for m in NON_ASCII.finditer(text)]
    judged = [model.judged[text[a - 1 if a else 0 : b + 1]] for a, b in spans]
    scores, last = [], None
    for (a, b), (score, _, _) in zip(spans, judged):
        if last is not None:
            scores.append(-0.01 * (a - last))
        scores.append(score)
        last = b
    # scores of stretches stand at even places
    runs = [(spans[a // 2][0], spans[(b - 1) // 2][1]) for a, b in maximal_segments(scores)]
    return Stretches(spans, judged, runs)


class Restorer:
    """Restores garbled parts of texts."""

    def __init__(self, model: Model, margin: float = 6.0):
        self.model, self.margin = model, margin
        self.utf8, self.single = model.utf8, model.single

    def _chains(self, text: str, longer: str, runs: list[tuple[int, int]], reader: Utf8ReadAs) -> list[tuple[int, int, str, float]]:
        out: list[tuple[int, int, str, float]] = []
        if not reader.chain.search(longer):
            return out
        for lo, hi in runs:
            for m in reader.chain.finditer(text, lo, hi):
                new = reader.restore(m.group())
                if new is None or any(ord(c) < 0x20 or 0x7F <= ord(c) < 0xA0 and not self._again(new) for c in new):
                    continue
                a, b = m.span()
                before, after = text[max(0, a - 1) : a], text[b : b + 1]
                gain = self.model.score(before + new + after) - self.model.score(before + m.group() + after)
                for c in new:
                    if ord(c) > 0xFFFF:
                        gain += 16.0  # four bytes in the right places are no accident
                    elif ord(c) not in self.model.known:
                        gain -= 24.0
                if gain > 0 and not self._quoted(text, a, b, new, reader):
                    out.append((a, b, new, gain))
        return out

    def _again(self, new: str) -> bool:
        """Controls may be left where another layer follows."""
        return any(r.chain.search(new) for r in self.utf8[:2])

    @staticmethod
    def _quoted(text: str, a: int, b: int, new: str, reader: Utf8ReadAs) -> bool:
        """The garbled token stands beside its clean form in one sentence."""
        if (a and not text[a - 1].isspace() and text[a - 1] not in "\"'“„(«") or (b < len(text) and not text[b].isspace() and text[b] not in "\"'”“),;»"):
            return False
        if reader.chain.search(new):
            return False
        lo = max(text.rfind("\n", 0, a), text.rfind(". ", 0, a)) + 1
        hi = min((i for i in (text.find("\n", b), text.find(". ", b)) if i >= 0), default=len(text))
        rest = text[lo:a] + "\n" + text[b:hi]
        return re.search(r"(?<!\S)[\"'“„(«]?" + re.escape(new) + r"[\"'”“),;.»]?(?!\S)", rest) is not None

    def _doubtful(self, text: str, found: Stretches) -> list[tuple[int, int, float]]:
        """Sentences that reach into a run and have many rare pairs, with their score."""
        if sum([r for _, r, _ in found.judged]) == 0:
            return []
        out, k, runs = [], 0, found.runs
        for m in SENTENCE.finditer(text):
            a, b = m.span()
            rare = pairs = 0
            first = k
            while k < len(found.spans) and found.spans[k][0] < b:
                rare, pairs = rare + found.judged[k][1], pairs + found.judged[k][2]
                k += 1
            if pairs and rare >= 0.25 * pairs and any(lo < b and a < hi for lo, hi in runs) and self._may_gain(text, found.spans[first:k]):
                out.append((a, b, self.model.score(text[max(0, a - 1) : b + 1])))
        return out

    def _may_gain(self, text: str, spans: list[tuple[int, int]]) -> bool:
        """Some one-byte mapping raises the score of these stretches together."""
        gains = [self.model.gains[text[a - 1 if a else 0 : b + 1]] for a, b in spans]
        return any([sum(g) > 0.4 for g in zip(*gains)])

    def _sentences(self, text: str, sentences: list[tuple[int, int, float]], runs: list[tuple[int, int]], mapping: OneByte) -> list[tuple[int, int, str, float]]:
        found = []
        for a, b, old in sentences:
            new = self._inside(text, a, b, runs, mapping)
            if new is None or not self.model.familiar(new):
                continue
            before, after = text[max(0, a - 1) : a], text[b : b + 1]
            gain = self.model.score(before + new + after) - old
            if gain <= 0.5:
                continue
            of_all = self.model.score_of_all(before + new + after) - self.model.score_of_all(before + text[a:b] + after)
            certain = of_all > self.margin or (gain > self.margin and not self._alone(text, a, b))
            found.append((a, b, new, gain, certain))
        sure = any(x[4] for x in found)
        return [x[:4] for x in found] if sure else []

    @staticmethod
    def _inside(text: str, a: int, b: int, runs: list[tuple[int, int]], mapping: OneByte) -> str | None:
        """text[a:b] with what lies inside the runs mapped; None if that can't be."""
        out, at = [], a
        for lo, hi in runs:
            lo, hi = max(lo, a), min(hi, b)
            if lo < hi:
                new = mapping.restore(text[lo:hi])
                if new is None:
                    return None
                out += [text[at:lo], new]
                at = hi
        return "".join(out) + text[at:b] if out else None

    @staticmethod
    def _alone(text: str, a: int, b: int) -> bool:
        """All non-ASCII characters of the sentence stand alone, beside no letter or digit."""
        spans = [m.span() for m in NON_ASCII.finditer(text, a, b)]
        return all(hi - lo == 1 and not text[lo - 1 : lo].isalnum() and not text[hi : hi + 1].isalnum() for lo, hi in spans)

    def restore(self, text: str | None) -> str | None:
        """The restored text, or None if nothing in it is garbled."""
        if not text or text.isascii():
            return None
        now, before = text, {text}
        while True:
            found = improbable_runs(now, self.model)
            if not found.runs:
                break
            # byte groups lie within stretches of two characters at least
            longer = " ".join({now[a:b] for a, b in found.spans if b - a > 1})
            best = max((self._chains(now, longer, found.runs, r) for r in self.utf8), key=lambda o: sum(x[3] for x in o))
            if sentences := self._doubtful(now, found):
                best = max([best, *(self._sentences(now, sentences, found.runs, m) for m in self.single)], key=lambda o: sum(x[3] for x in o))
            if not best:
                break
            for a, b, new, _ in reversed(best):
                now = now[:a] + new + now[b:]
            if now in before:  # layers are taken off, never put back
                break
            before.add(now)
        return now if now != text else None


def _restored(stats: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(Model(stats))
        for batch in batches:
            ids = batch.column("id")
            take, texts = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                if not t or t.isascii():
                    continue
                if REPLACEMENT in t:
                    take.append(i)
                    texts.append(None)
                elif (new := restorer.restore(t)) is not None:
                    take.append(i)
                    texts.append(new)
            if take:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(take)), pa.array(texts, pa.string())], names=["id", "restored"])

    return run


def restored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, restored): every garbled text restored, null where characters are lost."""
    stats = corpus_statistics(docs, text_col)
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(_restored(stats), "id long, restored string")
