"""Personal information inside free text: mentions, typed placeholders and keyed surrogates.

Mentions are found by shape (addresses, numbers, e-mail forms) and, for names, by the token lists together with the
words around them. Each distinct mention of the corpus gets one keyed replacement of its own kind and format; a
collision pass over all of them keeps distinct mentions distinct, and equal mentions stay equal.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.runtime import cut, maybe_broadcast

KINDS = ("email", "id_number", "phone", "address", "name")
_DROPPED = {0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF}
_LIKE = {0x00A0: " ", 0x3000: " ", 0x2009: " ", 0x202F: " ", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2019: "'", 0x2018: "'", 0x02BC: "'"}

_AT = r"(?:@|\s?\[at\]\s?|\s?\(at\)\s?|\sat\s)"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
EMAIL = re.compile(
    rf"(?<![\w.+@-])[A-Za-z0-9_][\w.+'-]*(?:{_AT}|\s@\s)(?:[\w-]+{_DOT})+[A-Za-z]{{2,}}(?![\w@])",
    re.I,
)
#: Words for kinds of identity numbers; what stands between them and the number is not part of it.
_ID_LEAD = (
    r"(?:passport|passeport|pasaporte|reisepass|ssn|social security|national insurance|\binsur(?:ance|ed)|\bni\b|\bnino\b|tax id|tax|taxpayer|tin|steuer-?id|steuernummer|s[ée]cu|citizen id|"
    r"personal number|personnummer|personalausweis|identity|\bid\b|\bdni\b|\bnie\b|\bnif\b|\bbsn\b|\bcpf\b|codice fiscale|driving licen[cs]e|driver'?s licen[cs]e)"
)
_ID_VALUE = (
    r"(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{2} \d{3} \d{3} \d{3}|\d{3} \d{2} \d{4}|\d{3} \d{6}|\d{5} \d{4}|\d{6}[-+ ]\d{4}|[A-Z]{1,2}\d{6,9}|\d{7,8}-?[A-Z]|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|\d{8,11}|\d(?:[ .\-/]?\d){6,11})"
)
ID_NUMBER = re.compile(rf"{_ID_LEAD}(?:[\s:#.,]|\b(?:number|no|nr|n[°º]|num|numero|card|code|ssn|id|passport|social|security|tax|dni|ni|national|insurance|insured|under|citizen|personal|steuer-?id|s[ée]cu|is|was)\b|n[°º]|steuer-)*({_ID_VALUE})(?![\w])", re.I)
#: Shapes that no other number has: US social security, UK national insurance, Spanish identity, Italian fiscal code.
ID_BARE = re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]?\d{7,8}-?[A-Z]|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])(?![\w-])", re.I)
PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .\-/]?\d){6,11}"
    r"|00\d{2}[ .-]\(?\d(?:[ .\-/]?\d){7,10}"
    r"|\(0?\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
    r"|1[-. ]\d{3}[-. ]\d{3}[-. ]\d{4}"
    r"|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}"
    r"|0\d(?:[. -]\d{2}){4}"
    r"|0\d{1,4}[ /-]\d{3,8}(?:[ -]\d{3,4})?"
    r")(?![\w]|[-/.]\d)",
    re.I,
)
PHONE_LED = re.compile(r"(?:\bcall|\bring|\btel|\btext me|\breach [\w ]{1,20} on|\bmobile(?: is)?|\bphone(?: is)?|\bdial|\bfax|\bmob)[\s:.]*(\+?\(?\d{1,4}\)?(?:[ .\-/]?\d){6,12})(?![\w]|-\d)", re.I)
PHONE_SHORT = re.compile(r"(?:\bcall|\bring|\btel|\btext me|\breach [\w ]{1,20} on|\bmobile(?: is)?|\bphone(?: is)?|\bdial)[\s:.]*(\d{3}[- ]\d{4})(?![\w]|-\d)", re.I)
_WAY = r"(?:street|st|road|rd|avenue|ave|lane|ln|close|boulevard|blvd|drive|way|court|terrace|crescent|square|row|gardens|mews|hill)"
_NAME = r"[^\W\d_][\w'-]*"
ADDRESS = re.compile(
    rf"(?<![\w.,/-])\d{{1,4}}[a-z]?(?:-\d{{1,4}})?,? +{_NAME}(?: {_NAME})?? +{_WAY}\b\.?"
    rf"|(?<![\w.,/-])\d{{1,4}}[a-z]?(?: ?bis| ?ter)?,? +(?:rue|avenue|boulevard|chemin|all[ée]e|quai|impasse|place|route) +(?:(?:des|du|de|les|la|le)\b *|[ld]'){{0,3}}{_NAME}(?-i: [A-ZÀ-Þ][\w'-]*)?"
    rf"|\b[^\W\d_]{{3,}}(?:stra(?:ß|ss)e|str\.|gasse|weg|platz|allee|damm|ufer|straat|laan|gracht|kade|plein) +\d{{1,4}}[a-z]?\b"
    rf"|\b(?:via|viale|piazza|corso|largo|vicolo|calle|plaza|avenida|paseo|camino|rua|praça|travessa)(?: +(?:de|del|della|delle|dei|degli|los|las|la|el|da|do|dos|das)){{0,2}} +{_NAME}(?: {_NAME})??,? +(?:n[.°º]* *)?\d{{1,4}}[a-z]?\b",
    re.I,
)
#: What follows or precedes a name that belongs to something else than a person.
_THING_AFTER = set("freight street st road rd avenue ave lane ln close blvd boulevard group ltd inc gmbh foundation summit stadium arena park bridge tower museum university college school hospital tickets ticket garden gardens market station hall house award cup field fields festival airport harbour valley".split())
_THING_BEFORE = set("storm hurricane cyclone saint st hms ss camp port mount lake fort".split())
_TITLES = r"(?:dr|mr|mrs|ms|miss|prof|professor|sir|herr|frau|mme|m|sr|sra|sig)"
#: After these words an unknown token beside a known one is taken for a name; the strong ones stand before persons only.
_LEAD = re.compile(rf"(?:\b(?:says|(?<!in )from|thanks to|ask for|missing|witness|signed|neighbou?r|contact|patient|victim|suspect|driver|named)[\s,:]+(?:{_TITLES}\.?\s+)?|\b{_TITLES}\.?\s+)$", re.I)
_STRONG = re.compile(rf"(?:\b(?:says|witness|signed,|neighbou?r|missing:)\s+(?:{_TITLES}\.?\s+)?|\b(?:dr|mr|mrs|ms|prof)\.?\s+)$", re.I)
_TOKEN = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*\.?")


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text without invisible characters and with look-alikes made plain, and where each character came from."""
    if text.isascii():
        return text, None
    kept, at = [], []
    for i, c in enumerate(text):
        o = ord(c)
        if o in _DROPPED:
            continue
        kept.append(_LIKE.get(o, c))
        at.append(i)
    at.append(len(text))
    return "".join(kept), at


class Finder:
    """Finds mentions; `given` and `family` are lower-case token lists that may be incomplete."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family = given, family

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """`(kind, start, end)` of each mention, in order, without overlaps."""
        if not text:
            return []
        flat, back = plain(text)
        found: list[tuple[str, int, int]] = []
        taken: list[tuple[int, int]] = []

        def add(kind: str, a: int, b: int) -> None:
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                found.append((kind, a, b))

        if "@" in flat or re.search(r"[\[( ]at[\]) ]", flat, re.I):
            for m in EMAIL.finditer(flat):
                add("email", *m.span())
        if any(c.isdigit() for c in flat):
            for m in ID_NUMBER.finditer(flat):
                add("id_number", *m.span(1))
            for m in ID_BARE.finditer(flat):
                add("id_number", *m.span())
            for m in ADDRESS.finditer(flat):
                add("address", *m.span())
            for m in PHONE.finditer(flat):
                if not self._counted(flat, m.start()):
                    add("phone", *m.span())
            for rule in (PHONE_LED, PHONE_SHORT):
                for m in rule.finditer(flat):
                    add("phone", *m.span(1))
        for a, b in self._names(flat):
            add("name", a, b)
        found.sort(key=lambda x: x[1])
        return [(k, a, b) if back is None else (k, back[a], back[b - 1] + 1) for k, a, b in found]

    @staticmethod
    def _counted(flat: str, at: int) -> bool:
        """A number that is announced as something else than a telephone."""
        before = flat[max(0, at - 14) : at].lower()
        return bool(re.search(r"(?:ticket|order|isbn|trk|parcel|invoice|item|file|ref|score|season|route|from|costs?) ?[a-z-]{0,5} ?$", before))

    def _names(self, flat: str) -> Iterator[tuple[int, int]]:
        tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(flat)]
        i = 0
        while i < len(tokens) - 1:
            hit = self._name_at(flat, tokens, i)
            if hit:
                yield tokens[i][0], hit[0]
                i = hit[1]
            else:
                i += 1

    def _name_at(self, flat: str, tokens: list[tuple[int, int, str]], i: int) -> tuple[int, int] | None:
        (a0, a1, first), (b0, b1, second) = tokens[i], tokens[i + 1]
        gap = flat[a1:b0]
        low1, low2 = first.lower().rstrip("."), second.lower().rstrip(".")
        initial = len(low1) == 1 and first.endswith(".")
        known = low1 in self.given, low1 in self.family, low2 in self.given, low2 in self.family
        before = flat[max(0, a0 - 40) : a0]
        common = low1 in _COMMON and low1 not in self.given
        strong = bool(_STRONG.search(before)) and not common
        if not any(known) and not strong and not (initial and _LEAD.search(before)):
            return None
        end, after = b1 - second.endswith("."), i + 2
        # Family name, comma, given name.
        if gap.strip() == "," and "\n" not in gap:
            if (known[1] and known[2]) or ((known[1] or known[2] or (strong and first[:1].isupper() and low2 not in _COMMON)) and _LEAD.search(before) and first[:1].isupper() == second[:1].isupper() and len(low1) > 2 and len(low2) > 2):
                return (end, after) if self._person(flat, tokens, i, after) and not (known[0] and not known[1]) else None
            return None
        if gap.strip(" \t") or not gap:
            if not (initial and not gap):
                return None
        # Given name, middle initial, family name.
        middle = len(low2) == 1 and (second.endswith(".") or second.isupper()) and i + 2 < len(tokens)
        if middle and not initial:
            c0, c1, third = tokens[i + 2]
            low3 = third.lower().rstrip(".")
            if not flat[b1:c0].strip(" \t") and len(low3) > 1 and low3 not in _COMMON and (low1 in self.given or low3 in self.family or strong):
                if (low1 in self.given and low3 in self.family) or _LEAD.search(flat[max(0, a0 - 40) : a0]):
                    end, after = c1 - third.endswith("."), i + 3
                    return (end, after) if self._person(flat, tokens, i, after) else None
            return None
        if initial:
            return (end, after) if (known[3] or (_LEAD.search(before) and len(low2) > 2 and low2 not in _COMMON)) and self._person(flat, tokens, i, after) else None
        if first.endswith(".") or len(low2) < 2:
            return None
        if (known[0] and known[3]) or (known[1] and known[2] and not known[0]):
            return (end, after) if self._person(flat, tokens, i, after) else None
        # One token known, the other not on the (incomplete) lists.
        if (((known[0] or known[3]) and _LEAD.search(before)) or strong) and first[:1].isupper() == second[:1].isupper() and not common and low2 not in _COMMON:
            return (end, after) if self._person(flat, tokens, i, after) else None
        return None

    @staticmethod
    def _person(flat: str, tokens: list[tuple[int, int, str]], i: int, after: int) -> bool:
        follows = tokens[after][2].lower().rstrip(".") if after < len(tokens) and not flat[tokens[after - 1][1] : tokens[after][0]].strip(" \t") and not tokens[after - 1][2].endswith(".") else ""
        leads = tokens[i - 1][2].lower().rstrip(".") if i and not flat[tokens[i - 1][1] : tokens[i][0]].strip(" \t") else ""
        return follows not in _THING_AFTER and leads not in _THING_BEFORE


_COMMON = set("a an and are as at be been but by for from had has have he her here his i in is it its just me my no not now of off on or our out please so that the their them then there they this to today up us was we were what when where which who why will with you your reported pass said says thanks still more about after all over call ring text tel mail write leaked list send proof someone posted contact signed missing witness ask nothing else house meet outside deliver live evacuated registered form claim filed crews officials council analysts volunteers locals honestly is anyone watching nobody expected new figures compare ticket main storm rose garden".split())


def load_finder(names: DataFrame, bound: int = 200_000) -> Finder:
    """The token lists of `names(token, token_kind)`; a list longer than `bound` is refused, as it goes to every task."""
    rows = names.where("token is not null").select(F.lower("token").alias("t"), "token_kind").distinct().limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} name tokens")
    tidy = lambda t: t.replace("’", "'")
    return Finder({tidy(r.t) for r in rows if r.token_kind == "given"}, {tidy(r.t) for r in rows if r.token_kind == "family"})


def mentions(docs: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """`(key, kind, start_at, end_at, mention)`: every mention with its place in code points.

    Null keys are dropped, null and empty texts hold nothing, repeated rows repeat their mentions, texts are read
    whole; an empty table gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_finder(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = sent.value.find
        for pdf in batches:
            rows = [(k, kind, a, b, t[a:b]) for k, t in zip(pdf.k, pdf.t) for kind, a, b in find(t)]
            yield pd.DataFrame(rows, columns=[key, "kind", "start_at", "end_at", "mention"])

    lean = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null and length(t) > 0")
    return lean.mapInPandas(run, f"`{key}` long, kind string, start_at long, end_at long, mention string")


def same_entity(kind: str, mention: str) -> str:
    """What two mentions of one entity have in common: digits for numbers, sorted name tokens, bare lower case."""
    if kind == "phone":
        digits = re.sub(r"\D", "", mention.replace("(0)", ""))
        return digits[2:] if digits.startswith("00") else digits
    if kind == "id_number":
        return re.sub(r"\W", "", mention).upper()
    if kind == "email":
        return re.sub(r"\s?[\[(]?\bdot\b[\])]?\s?", ".", re.sub(r"\s?[\[(]?\bat\b[\])]?\s?|\s@\s", "@", mention.lower()))
    words = re.findall(r"\w+", mention.lower())
    return " ".join(sorted(words) if kind == "name" else words)


_SYLLABLES = [a + b for a in "b d f g h k l m n p r s t v w z".split() for b in ("a", "e", "i", "o", "u")]

#: Letters that stand in for words of other scripts, by the range of a word's first letter.
_SCRIPTS = (
    ("\u0370", "\u03ff", "αβγδεζηθικλμνοπρστυφχψω"), ("\u0400", "\u04ff", "абвгдежзиклмнопрстуфхцчшэюя"), ("\u0590", "\u05ff", "אבגדהוזחטיכלמנסעפצקרשת"),
    ("\u0600", "\u06ff", "ابتثجحخدرزسشصضطعغفقكلمنهوي"), ("\u4e00", "\u9fff", "安白成大方高国海和江金李林明南平清山石天文小新玉月云长正中"),
)


def surrogate(key: bytes, kind: str, entity: str, mention: str, attempt: int) -> str:
    """A keyed replacement in the mention's own format: digits for digits, pronounceable letters for words, case kept."""
    seed = hmac.new(key, f"{kind}\x00{entity}\x00{attempt}".encode(), hashlib.sha256).digest()
    stream = int.from_bytes(seed + hashlib.sha256(seed).digest(), "big")

    def draw(n: int) -> int:
        nonlocal stream
        stream, out = divmod(stream, n)
        return out

    def word(m: re.Match[str]) -> str:
        old = m.group()
        if kind in ("phone", "id_number"):
            return "".join("ABCDEFGHJKLMNPRSTVWXYZ"[draw(22)] for _ in old)
        if kind == "email" and re.search(r"@|\bat\b", mention[: m.start()], re.I):
            return old if m.end() == len(mention) or old.lower() in ("dot", "at") else "mail"
        if old.lower() in ("at", "dot") or (kind == "address" and re.fullmatch(rf"{_WAY}|rue|via|viale|calle|plaza|avenida|de|du|des|del|la|le|los|delle|bis", old, re.I)):
            return old
        letters = next((x for low, high, x in _SCRIPTS if low <= old[0].lower() <= high), None)
        if letters:
            new = "".join(letters[draw(len(letters))] for _ in old)
            return new.capitalize() if old[0].isupper() and not old[1:].isupper() else new.upper() if old.isupper() else new
        if len(old) == 1:
            return "ABCDEFGHJKLMNPRSTVW"[draw(19)] if old.isupper() else "abcdefghjklmnprstvw"[draw(19)]
        new = "".join(_SYLLABLES[draw(len(_SYLLABLES))] for _ in range(max(2, (len(old) + 1) // 2)))
        tail = re.search(r"(straße|strasse|gasse|weg|straat|laan)$", old, re.I) if kind == "address" else None
        new += tail.group().lower() if tail else ""
        return new.upper() if old.isupper() else new.capitalize() if old[0].isupper() else new

    out = re.sub(r"[^\W\d_]+", word, mention)
    return re.sub(r"\d", lambda _: str(draw(10)), out)


def redacted(docs: DataFrame, names: DataFrame, key: str, text: str, secret: bytes, style: str = "placeholder", max_rounds: int = 20) -> DataFrame:
    """`(key, text, redacted, n_mentions)` for every row with a non-null key; rows without mentions keep their text.

    `style="placeholder"` writes `[KIND-code]`, `style="surrogate"` a replacement of the same format. The code or
    surrogate depends on `secret` and the entity only, so mentions of one entity agree over the corpus; entities whose
    replacements collide, or whose surrogate names an entity of the corpus, are drawn again until all are distinct; if
    some still collide after `max_rounds`, an error is raised. Keys are expected once.
    """
    spark = docs.sparkSession
    found = cut(mentions(docs, names, key, text))
    def common(kind: pd.Series, mention: pd.Series) -> pd.Series:
        return pd.Series([same_entity(k, m) for k, m in zip(kind, mention)], dtype=object)

    canon = F.pandas_udf(common, "string").asNondeterministic()
    tagged = cut(found.withColumn("entity", canon("kind", "mention")))
    entities = tagged.groupBy("kind", "entity").agg(F.min("mention").alias("model")).withColumn("attempt", F.lit(0))
    if style == "placeholder":
        def make(kind: pd.Series, entity: pd.Series, model: pd.Series, attempt: pd.Series) -> pd.Series:
            return pd.Series([f"[{k.upper()}-{hmac.new(secret, f'{k}\x00{e}\x00{a}'.encode(), hashlib.sha256).hexdigest()[:10]}]" for k, e, a in zip(kind, entity, attempt)])
    else:
        def make(kind: pd.Series, entity: pd.Series, model: pd.Series, attempt: pd.Series) -> pd.Series:
            return pd.Series([surrogate(secret, k, e, m, a) for k, e, m, a in zip(kind, entity, model, attempt)])
    draw = F.pandas_udf(make, "string")
    placed = cut(entities.withColumn("new", draw("kind", "entity", "model", "attempt")))
    real = placed.select(F.col("kind").alias("k3"), F.col("entity").alias("e3"))
    for turn in range(max_rounds + 1):
        keeper = placed.groupBy(F.col("kind").alias("k2"), F.col("new").alias("n2")).agg(F.min("entity").alias("keeper"), F.count("*").alias("n")).where("n > 1")
        clash = placed.join(keeper, (F.col("kind") == F.col("k2")) & (F.col("new") == F.col("n2")), "left").withColumn("said", canon("kind", "new"))
        clash = clash.join(real, (F.col("kind") == F.col("k3")) & (F.col("said") == F.col("e3")), "left")
        again = (F.col("keeper").isNotNull() & (F.col("keeper") != F.col("entity"))) | F.col("e3").isNotNull()
        clash = cut(clash.select("kind", "entity", "model", "attempt", again.alias("again")))
        if clash.where("again").isEmpty():
            break
        if turn == max_rounds:
            raise ValueError(f"replacements still collide after {max_rounds} rounds")
        placed = cut(clash.select("kind", "entity", "model", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")).withColumn("new", draw("kind", "entity", "model", "attempt")))
    n = placed.count()
    pieces = tagged.join(maybe_broadcast(placed.select("kind", "entity", "new"), n), ["kind", "entity"])
    lists = pieces.distinct().groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_at", "end_at", "new"))).alias("cuts"))
    whole = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).where(F.col(key).isNotNull()).join(lists, key, "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda s, c: F.struct(F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, c["start_at"] - s["at"]), c["new"]).alias("out"), c["end_at"].alias("at"))
    built = F.aggregate("cuts", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return whole.select(key, "text", F.coalesce(built, F.col("text")).alias("redacted"), F.coalesce(F.size("cuts"), F.lit(0)).cast("long").alias("n_mentions"))
