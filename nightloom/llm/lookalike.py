"""One canonical form for texts that look the same.

Nearly all of a corpus is already canonical. Character properties decide that
quickly: a text is stable when no character of it composes, decomposes, is
invisible, is a variant blank, hyphen, width or ligature, and when its letters
come from one script only. Plain ASCII texts, which the JVM tells by their
length in bytes, never reach Python; the rest takes this test there, a linear
pass of one compiled pattern. In texts that fail only the unstable segments (a word or a
run of blanks around an unstable character, so composition sees its context)
are rewritten and spliced between the untouched pieces.

Look-alike letters cannot be told apart one by one, so each is first folded to
its class; the script of the class's letter in a word is then chosen from the
letters that have no double, which both writings share. The result therefore
depends only on how the text looks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded, cut

#: Copies of one writing beyond which they are joined in so many parts.
_CROWD, _SPREAD = 100_000, 64

# Letters that print alike; a group begins with its Latin letter,
# the others are of any script (Latin, Cyrillic, Greek or Armenian, by name).
ALIKE = (
    "aаɑ cсϲ dԁ eе gɡ hһհ iі jјϳ lӏ nո oоοօ pрρ qԛ sѕ uս vνѵ wԝ xх yу "
    "AАΑ BВΒ CСϹ EЕΕ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟՕ PРΡ QԚ SЅ TТΤ UՍ VѴ WԜ XХΧ YҮΥ ZΖ"
)
# Characters that do not show, besides the format characters (category Cf).
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ"
# Hyphens of other kinds.
HYPHENS = "‐‑⁃﹣－"
# Line breaks of other kinds.
BREAKS = "\u0085  "

SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
_LATIN, _CYRILLIC, _GREEK, _ARMENIAN = range(len(SCRIPTS))


def _script(ch: str) -> int | None:
    name = unicodedata.name(ch, "").removeprefix("FULLWIDTH ")
    return next((k for k, script in enumerate(SCRIPTS) if name.startswith(script)), None)


def _classes() -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
    """Each look-alike letter's class (a Latin letter), and the class's letter in each script."""
    member, forms = {}, {}
    for group in ALIKE.split():
        head, *others = group
        by = {_LATIN: head}
        for ch in (head, *others):
            member[ch] = head
            by.setdefault(_script(ch), ch)
        forms[head] = tuple(by.get(s, head) for s in range(len(SCRIPTS)))
    return member, forms


CLASS_OF, FORMS = _classes()


@lru_cache(maxsize=100_000)
def _plain(ch: str) -> str:
    """A character without differences of width, blank, hyphen, ligature or visibility; decomposed."""
    if ch in HYPHENS:
        return "-"
    if ch in BREAKS:
        return "\n"
    kind = unicodedata.category(ch)
    if kind == "Cf" or ch in UNSEEN or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if kind == "Zs":
        return " "
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag in ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"):
        return "".join(_plain(chr(int(x, 16))) for x in rest.split())
    if tag == "<compat>" and (parts := [chr(int(x, 16)) for x in rest.split()]):
        joined = len(parts) > 1 and all(unicodedata.category(p)[0] == "L" for p in parts) and not ch.isnumeric()
        if joined or ch == "µ":
            return "".join(_plain(p) for p in parts)
    return unicodedata.normalize("NFD", ch)


def _ranges(points: list[int]) -> str:
    """A character class that Java's and Python's regular expressions both read."""
    out, start, last = [], None, None
    esc = lambda p: f"\\u{p:04x}"
    for p in [*points, None]:
        if start is not None and p != last + 1:
            out.append(esc(start) if start == last else f"{esc(start)}-{esc(last)}")
            start = None
        if p is not None:
            start = p if start is None else start
            last = p
    return "".join(out)


def _stable() -> tuple[str, dict[int, str], dict[int, str]]:
    """Regular-expression classes: stable characters without a script, stable letters by script, and those of them without a double.

    A character is stable when it is its own plain form composed, never joins
    the character before it, and is no look-alike from outside the three
    scripts' own alphabets. Only the blocks that texts in these scripts are made
    of are listed, which keeps the classes short and the test quick; anything
    else takes the careful way, with the same outcome.
    """
    common, letters, single = [], {k: [] for k in range(len(SCRIPTS))}, {k: [] for k in range(len(SCRIPTS))}
    for p in (*range(9, 11), *range(32, 127), *range(0xA1, 0x250), *range(0x370, 0x590), *range(0x2012, 0x2028), *range(0x2030, 0x2040), *range(0x20A0, 0x20C0), *range(0x2500, 0x2600)):
        ch = chr(p)
        if unicodedata.category(ch) in ("Cn", "Co", "Cs") or unicodedata.combining(ch) or unicodedata.category(ch)[0] == "M":
            continue
        if unicodedata.normalize("NFC", _plain(ch)) != ch or not unicodedata.is_normalized("NFC", ch):
            continue
        script = _script(ch)
        if script is None:
            if 0x1100 <= p <= 0x11FF or ch in CLASS_OF:
                continue
            common.append(p)
        elif script == _LATIN and ch in CLASS_OF and CLASS_OF[ch] != ch:
            continue
        elif FORMS.get(CLASS_OF.get(ch, ""), (ch,) * len(SCRIPTS))[script] == ch:
            letters[script].append(p)
            if not any(c in CLASS_OF for c in unicodedata.normalize("NFD", ch)):
                single[script].append(p)
    return _ranges(common), {s: _ranges(v) for s, v in letters.items()}, {s: _ranges(v) for s, v in single.items()}


_COMMON, _LETTERS, _SINGLE = _stable()
# Without a letter that has no double, a text in another script is spelt in Latin.
_WHOLE = {s: ("" if s == _LATIN else f"(?=[^{_SINGLE[s]}]*+[{_SINGLE[s]}])") + f"[{_COMMON}{_LETTERS[s]}]*+" for s in range(len(SCRIPTS))}
# What may make an ASCII text unstable.
_CONTROLS = r"[\x00-\x08\x0b-\x1f\x7f]"

_LETTER = r"[^\W\d_]"
#: A word with what may belong to it (marks, invisible characters), or one blank, hyphen or other unstable character.
_SEGMENT = re.compile(rf"(?:{_LETTER}|[̀-ͯ]|[{re.escape(UNSEEN)}­​-‏‪-‮⁠-⁤︀-️﻿])+|[^{_COMMON}]")
_QUICK = {s: re.compile(pattern).fullmatch for s, pattern in _WHOLE.items()}


@lru_cache(maxsize=200_000)
def _skeleton(segment: str) -> tuple[str, tuple[int, ...]]:
    """A segment in look-alike classes, decomposed, and its count of letters without a double by script."""
    out, votes = [], [0] * len(SCRIPTS)
    for ch in unicodedata.normalize("NFD", "".join(map(_plain, segment))):
        if ch in CLASS_OF:
            out.append(CLASS_OF[ch])
            continue
        out.append(ch)
        if ch.isalpha() and (script := _script(ch)) is not None:
            votes[script] += 1
    return unicodedata.normalize("NFD", "".join(out)), tuple(votes)


def folded(ch: str) -> str:
    """What a single character is compared by: decomposed, look-alikes as the Latin letter of their group."""
    return _skeleton(ch)[0]


def _lean(votes: list[int] | tuple[int, ...]) -> int | None:
    top = max(votes)
    return list(votes).index(top) if top else None


@lru_cache(maxsize=200_000)
def _spelt(skeleton: str, script: int) -> str:
    return unicodedata.normalize("NFC", "".join(FORMS[c][script] if c in FORMS else c for c in skeleton))


@lru_cache(maxsize=1)
def _second_starters() -> frozenset[str]:
    """Characters that are no marks and yet may compose with the one before (quick check "maybe"), besides Hangul."""
    pairs = (unicodedata.decomposition(chr(p)).split() for p in range(0xA0, 0x30000))
    seconds = {chr(int(d[1], 16)) for d in pairs if len(d) == 2 and not d[0].startswith("<")}
    return frozenset(c for c in seconds if not unicodedata.combining(c))


@lru_cache(maxsize=100_000)
def _may_join(ch: str) -> bool:
    """Whether a character may compose with, or be ordered among, what stands before it."""
    return bool(unicodedata.combining(ch)) or "\u1161" <= ch <= "\u11ff" or ch in _second_starters()


def _spliced(pieces: list[str]) -> str:
    """Composed pieces put together; only the seams at which composition could go on are normalised.

    A seam reaches from the last character before it that joins nothing to the
    first one after it that joins nothing.
    """
    out: list[str] = []
    for piece in pieces:
        if not piece:
            continue
        if not out or not _may_join(piece[0]):
            out.append(piece)
            continue
        head = next((i for i, ch in enumerate(piece) if not _may_join(ch)), len(piece))
        tail = ""
        while out:
            last = out.pop()
            cut = next((i for i in range(len(last) - 1, -1, -1) if not _may_join(last[i])), None)
            if cut is not None:
                out.append(last[:cut])
                tail = last[cut:] + tail
                break
            tail = last + tail
        out += [unicodedata.normalize("NFC", tail + piece[:head]), piece[head:]]
    return "".join(out)


def canonical(text: str | None) -> str | None:
    """The canonical form of a text; null stays null, and the form of a form is itself."""
    if text is None or any(quick(text) for quick in _QUICK.values()):
        return text
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    pieces, at, undecided, total = [], 0, [], [0] * len(SCRIPTS)
    for m in _SEGMENT.finditer(text):
        segment = m.group()
        skeleton, votes = _skeleton(segment)
        lean = _lean(votes)
        pieces.append(text[at : m.start()])
        at = m.end()
        if lean is None and any(c in FORMS for c in skeleton):
            undecided.append(len(pieces))
            pieces.append(skeleton)
        else:
            pieces.append(_spelt(skeleton, lean or 0))
        for s, n in enumerate(votes):
            total[s] += n
    pieces.append(text[at:])
    whole = _lean(total) or 0
    for k in undecided:
        pieces[k] = _spelt(pieces[k], whole)
    return _spliced(pieces)


def _rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical forms; null where the text is its own."""
    for texts in batches:
        yield pd.Series([None if t is None or (c := canonical(t)) == t else c for t in texts], dtype=object)


def canonical_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` plus ``out``, the canonical form of ``text``.

    Texts that aren't plain ASCII pass through Python, whole, however long; only
    changed ones come back. Null gives null, the empty text itself. A column of the name
    ``out`` is replaced, every other column stays.
    """
    rewrite = F.pandas_udf(_rewrite, "string")
    unsure = (F.octet_length(text) != F.char_length(text)) | F.col(text).rlike(_CONTROLS)
    return df.withColumn(out, F.coalesce(rewrite(F.when(unsure, F.col(text))), F.col(text)))


def digest(text: Column) -> Column:
    """A 128-bit key of a text."""
    return F.unhex(F.md5(text.cast("binary")))


def looks(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``(ident, look, writing)`` of every non-null text: digests of its canonical form and of its characters."""
    rows = canonical_text(df.select(ident, text).where(F.col(text).isNotNull()), text, "_canonical")
    return rows.select(ident, digest(F.col("_canonical")).alias("look"), digest(F.col(text)).alias("writing"))


def alike_classes(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``(ident, class_id, n_members, n_links)``: one row per document, without pairs.

    class_id is the smallest id among the texts that look the same, n_members
    their number, n_links the number of those whose string differs. Rows with a
    null id or text are left out; an id with several texts has a row for each
    look. Counts are combined before the shuffle, so copies cost a row a task.
    """
    rows = cut(looks(df.where(F.col(ident).isNotNull()), ident, text).distinct())
    writings = cut(rows.groupBy("look", "writing").agg(F.count(F.lit(1)).alias("_same"), F.min(ident).alias("_first")))
    per_look = writings.groupBy("look").agg(F.sum("_same").alias("n_members"), F.min("_first").alias("class_id"))
    known = writings.join(per_look.hint("merge"), "look").select("look", "writing", "class_id", "n_members", (F.col("n_members") - F.col("_same")).alias("n_links"))
    # copies of one writing are spread over parts, and so is what they meet
    parts = F.explode(F.array(*map(F.lit, range(_SPREAD))))
    spread = rows.withColumn("_p", F.pmod(F.xxhash64(ident), F.lit(_SPREAD)).cast("int"))
    crowded = writings.where(F.col("_same") > _CROWD).select("writing").distinct()
    busy = spread.join(bounded(crowded), "writing", "left_semi") if not crowded.isEmpty() else None
    columns = [ident, "class_id", "n_members", "n_links"]
    if busy is None:
        return rows.join(known.hint("merge"), ["look", "writing"]).select(*columns)
    calm = spread.join(bounded(crowded), "writing", "left_anti").join(known.hint("merge"), ["look", "writing"]).select(*columns)
    wide = known.join(bounded(crowded), "writing", "left_semi").withColumn("_p", parts)
    return calm.unionByName(busy.join(wide.hint("merge"), ["look", "writing", "_p"]).select(*columns))


def alike_pairs(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Pairs of ids whose texts look the same and are different strings: ``(ident_a, ident_b)``, a before b.

    The distinct writings of a look are paired first, and only then joined to
    the ids, so a great group of identical copies costs what it contributes to
    the result (:func:`alike_classes` has the same links without pairs). Null
    texts and ids take no part, empty texts are alike only with texts that show
    nothing, repeated rows of one id count once.
    """
    rows = cut(looks(df.where(F.col(ident).isNotNull()), ident, text))
    writings = rows.groupBy("look", "writing").agg(F.count(F.lit(1)).alias("n"))
    several = writings.groupBy("look").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("look")
    members = cut(rows.join(bounded(several), "look", "left_semi").distinct())
    kinds = members.select("look", "writing").distinct()
    pairs = kinds.select("look", F.col("writing").alias("w1")).join(kinds.select("look", F.col("writing").alias("w2")).hint("merge"), "look").where("w1 < w2")
    one = members.select("look", F.col("writing").alias("w1"), F.col(ident).alias("i1"))
    two = members.select("look", F.col("writing").alias("w2"), F.col(ident).alias("i2"))
    both = pairs.join(one.hint("merge"), ["look", "w1"]).join(two.hint("merge"), ["look", "w2"]).where("i1 <> i2")
    return both.select(F.least("i1", "i2").alias(f"{ident}_a"), F.greatest("i1", "i2").alias(f"{ident}_b")).distinct()
