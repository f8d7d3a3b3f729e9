"""Text functions as Column expressions; only Unicode decomposition leaves the JVM."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They decide which titles are the same role.
REQUISITION = r"(?i)(\bjob\s*[-#:]?\s*\d{3,}\b|\breq(uisition)?\.?\s*(id|#|no\.?)?\s*[:#]?\s*[a-z]?-?\d{3,}\b|#\s*\d{3,}\b|\b[jr]-?\d{4,}\b)"
BRACKETED = r"\([^)]*\)|\[[^\]]*]|\{[^}]*}"
SEPARATOR = r"\s+[-–—|/]\s+|\s*[|•·]\s*|,\s+"
NON_WORD = r"[^a-z0-9+#]+"
ABBREVIATIONS = {
    "sr": "senior", "snr": "senior", "jr": "junior", "eng": "engineer", "engr": "engineer", "swe": "software engineer", "sde": "software engineer",
    "mgr": "manager", "mngr": "manager", "dir": "director", "vp": "vice president", "svp": "senior vice president", "evp": "executive vice president",
    "assoc": "associate", "admin": "administrator", "ops": "operations", "mktg": "marketing", "bdr": "business development representative",
    "sdr": "sales development representative", "ae": "account executive", "tpm": "technical program manager", "acct": "account", "exec": "executive",
    "ml": "machine learning", "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "&": "and",
}
WORK_ARRANGEMENT = (
    "remote hybrid onsite on site in office anywhere distributed us usa u s uk eu emea apac latam amer americas na north america europe asia global "
    "worldwide united states kingdom canada based only time zone zones est pst cst et pt ct east west coast central and or the multiple locations "
    "location full part contract contractor temporary temp fixed term"
).split()
TRAILING = r"( (remote|hybrid|onsite))+$"
COMPOUNDS = (("front end", "frontend"), ("back end", "backend"), ("full stack", "fullstack"))
TOKEN_BREAK = r"[^\p{L}\p{N}+#]+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\s\p{Z}]+", ""), r"[\s\p{Z}]+$", "")


def normalize_whitespace(c: Column) -> Column:
    """No-break spaces and runs of blanks are one space, line ends have none beside them, at most one empty line."""
    for pattern, new in ((" ", " "), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, new)
    return strip(c)


@F.arrow_udf(T.StringType())
def _decomposed(a: pa.Array) -> pa.Array:
    """Compatibility decomposition without combining marks."""
    plain = lambda s: s if s is None or s.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", s) if unicodedata.category(ch)[0] != "M")
    return pa.array([plain(s) for s in a.to_pylist()], pa.string())


def fold(c: Column) -> Column:
    """Lower case without accents; '&' stands alone, '.' is a space."""
    return F.replace(F.replace(F.lower(_decomposed(c)), F.lit("&"), F.lit(" & ")), F.lit("."), F.lit(" "))


def words(c: Column) -> Column:
    """Words of folded text: other characters than letters, digits, + and # are deleted within them."""
    cleaned = F.transform(F.split(c, r"\s+"), lambda w: F.when(w == "&", w).otherwise(F.regexp_replace(w, NON_WORD, "")))
    return F.filter(cleaned, lambda w: w != "")


def title_key(title: Column, location: Column | None = None) -> Column:
    """Canonical key of a posting's title: the same role in another formatting has the same key; null and blank
    titles have the empty one. Segments that only repeat the location or say where work is done are dropped,
    unless nothing would be left.
    """
    stop = F.array(*[F.lit(w) for w in WORK_ARRANGEMENT])
    if location is not None:
        stop = F.concat(stop, F.coalesce(words(fold(location)), F.array().cast("array<string>")))
    where = lambda ws, st: F.size(F.array_except(ws, st)) == 0
    # a struct of what is used several times, so that each is computed once: [{text, stop}] transformed
    base = F.array(F.struct(F.regexp_replace(fold(title), REQUISITION, " ").alias("t"), stop.alias("stop")))

    def unbracketed(b: Column) -> Column:
        outside, inside = F.split(b["t"], BRACKETED, -1), F.regexp_extract_all(b["t"], F.lit(f"({BRACKETED})"), F.lit(1))
        named = F.transform(inside, lambda s: words(F.substring(s, F.lit(2), F.length(s) - 2)))
        kept = F.transform(named, lambda ws: F.when(where(ws, b["stop"]), F.lit(" ")).otherwise(F.concat(F.lit(", "), F.array_join(ws, " "), F.lit(", "))))
        return F.array_join(F.flatten(F.zip_with(outside, kept, lambda o, k: F.array(o, F.coalesce(k, F.lit(""))))), "")

    def role(b: Column) -> Column:
        segments = F.filter(F.transform(F.split(unbracketed(b), SEPARATOR), words), lambda ws: F.size(ws) > 0)
        chosen = F.transform(F.array(segments), lambda ss: F.struct(ss.alias("all"), F.filter(ss, lambda ws: ~where(ws, b["stop"])).alias("kept")))[0]
        return F.transform(F.array(chosen), lambda c: F.when(F.size(c["kept"]) > 0, F.flatten(c["kept"])).otherwise(F.coalesce(F.get(c["all"], F.lit(0)), F.array().cast("array<string>"))))[0]

    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    expanded = F.transform(base, lambda b: F.array_join(F.transform(role(b), lambda w: F.coalesce(F.try_element_at(table, w), w)), " "))[0]
    key = F.regexp_replace(expanded, TRAILING, "")
    for old, new in COMPOUNDS:
        key = F.replace(key, F.lit(old), F.lit(new))
    return F.when(title.isNull() | (strip(title) == ""), F.lit("")).otherwise(key)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits, + and #."""
    return F.filter(F.split(F.lower(c), TOKEN_BREAK), lambda w: w != "")


def shingles(c: Column, size: int) -> Column:
    """The set of hashed runs of ``size`` words; of fewer words one run of all, of none the empty set."""
    ws = F.array(tokens(c))
    runs = lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < size, F.array(F.xxhash64(w))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))))
    return F.transform(ws, runs)[0]


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; of two empty ones it is 1."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def content_hash(title: Column, location: Column, department: Column, description: Column) -> Column:
    """SHA-256 in hex of the fields, each followed by a zero byte; null is the text 'null'."""
    parts = [x for c in (title, location, department, description) for x in (F.coalesce(c, F.lit("null")), F.char(F.lit(0)))]
    return F.sha2(F.concat(*parts), 256)


def like_escaped(text: str) -> str:
    """A LIKE pattern in which a stray escape before an ordinary character is that character."""
    out, i = "", 0
    while i < len(text):
        if text[i] == "\\" and (i + 1 == len(text) or text[i + 1] not in "%_\\"):
            out += "\\\\"
        elif text[i] == "\\":
            out += text[i : i + 2]
            i += 1
        else:
            out += text[i]
        i += 1
    return out
