"""Text functions as column expressions: cleansing, signatures, gate checks, previews, handles, identity tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python splits it, pictograph ranges, chatter and debate patterns, modal words, labels.
BLANK = r"[\s\x1c-\x1f\x85   -     　]"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{1F000}-\x{1F02F}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]+"
LINK = r"https?://\S+|www\.\S+"
CHATTER = ("lol", "lmao", "selfie", "fitcheck", "feeling cute", "hmu", "dm me", "bored af", "good morning yall", "gm everyone")
DEBATE = ("why", "should", "however", "despite", "because", "therefore", "in contrast", "whereas", "alternatively", "argues?", "proposes?", "debates?", "criticizes?", "according to", "consequence", "economic", "policy")
MODAL = ("should", "shouldn't", "shouldnt", "could", "couldn't", "couldnt", "must", "ought to", "will", "won't", "wont", "would", "wouldn't", "wouldnt", "may", "might", "never", "always")
IDENTITY_LABELS = ("ORG", "PRODUCT", "NORP", "PERSON")
GENERIC_HEADS = ("insiders", "observers", "supporters", "fans", "critics", "skeptics", "defenders", "detractors", "pundits", "experts", "analysts", "authorities", "officials", "sources", "advisors", "lawmakers", "leaders", "members", "followers", "community", "investors")

# Signal words. Verbs that count in all three forms, in two (not the plain one), and single words.
THREE_FORMS = "surge spike hike drop pivot downgrade rally rebound soar plummet tank evacuate upgrade"
TWO_FORMS = """boost crash plunge announce unveil launch warn claim criticize praise award approve reject veto pass vote negotiate sign report
confirm deny reveal publish release defeat resign retire raise jump merge acquire invest double test study show prove suggest
recommend ban legalize indict convict blame survive recover collapse close open hire fire call plan pledge promise"""
SIGNAL_WORDS = """drives drive driving strikes struck beats wins won loses lost cuts cut falls fell sells sold buys bought grows grew
finds found tops leads led overtakes overtook aims vows dovish hawkish news report result results update updates launch verdict
election vote ruling proposal reform crisis scandal alert warning announcement interview analysis surveys survey ban lawsuit
tariff agreement settlement shortage outbreak suspension ceasefire rounds round race match series tournament season winner
record yield hawk hawks dove doves study"""


def inflected(verb: str) -> tuple[str, str]:
    """Third person and past of a regular verb; short ones in -p and -n double their last letter."""
    soft = verb.endswith("y") and verb[-2] not in "aeiou"
    third = verb[:-1] + "ies" if soft else verb + ("es" if verb.endswith(("s", "x", "z", "ch", "sh", "to")) else "s")
    short = len(verb) <= 4 and verb[-1] in "pn" and verb[-2] in "aeiou" and verb[-3] not in "aeiou"
    past = verb[:-1] + "ied" if soft else verb + ("d" if verb.endswith("e") else verb[-1] + "ed" if short and verb not in ("open", "sign") else "ed")
    return third, past


def signal_lexicon() -> list[str]:
    """The words that show that a text reports something."""
    forms = [f for v in (THREE_FORMS + " " + TWO_FORMS).split() for f in inflected(v)]
    return sorted({*forms, *THREE_FORMS.split(), *SIGNAL_WORDS.split()})


def _words(options: tuple[str, ...]) -> str:
    return rf"(?U)\b(?:{'|'.join(options)})\b"


def strip_emoji(text: Column) -> Column:
    return F.regexp_replace(text, EMOJI, " ")


def squeeze(text: Column) -> Column:
    """Inner white space single, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def cleanse(text: Column) -> Column:
    """Without links, handles and punctuation, white space single."""
    bare = F.regexp_replace(F.regexp_replace(text, rf"(?U){LINK}", ""), r"(?U)@\w+", "")
    return squeeze(F.regexp_replace(bare, r"(?U)[^\w\s]", ""))


def content_signature(text: Column) -> Column:
    """63-bit fingerprint of the text without case, links and repeated white space; never 0, nulls count as empty."""
    plain = squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?U){LINK}", ""))
    digest = F.sha2(plain, 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    sig = high * F.lit(1 << 32) + low
    return F.when(sig == 0, F.lit(1).cast("long")).otherwise(sig)


def gate_precheck(text: Column) -> Column:
    """empty_text, too_short, chatter_marker, personal_diary, or null if the text goes on to `gate`."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANK}+|{BLANK}+$", "")
    bare = squeeze(strip_emoji(trimmed))
    words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))
    low = F.lower(bare)
    first = F.regexp_count(low, F.lit(r"(?U)\b(i|me|my|myself|im)\b"))
    return (
        F.when(trimmed == "", "empty_text").when(words < 7, "too_short").when(low.rlike(_words(CHATTER)), "chatter_marker")
        .when((first >= 3) & (first / F.greatest(words, F.lit(1)) > 0.22), "personal_diary")
    )


def gate(text: Column, has_entities: Column, proper_nouns: Column | None = None, lexicon: list[str] | None = None) -> Column:
    """The full gate: a precheck's reason, else valid_discourse or lacks_substance.

    Entities and proper nouns come from the caller's tagger as flags; `lexicon` lists signal words (`signal_lexicon`).
    """
    lexicon = signal_lexicon() if lexicon is None else lexicon
    bare = strip_emoji(F.trim(text))
    low = F.lower(bare)
    signal = F.arrays_overlap(F.split(squeeze(low), " "), F.array(*[F.lit(w) for w in lexicon])) if lexicon else F.lit(False)
    marked = low.rlike(_words(DEBATE)) | low.rlike(_words(MODAL)) | low.rlike(r"#(?:breaking|news|update|alert)\b") | bare.contains("?")
    return F.coalesce(gate_precheck(text), F.when(has_entities | marked | signal | (F.lit(False) if proper_nouns is None else proper_nouns), "valid_discourse").otherwise("lacks_substance"))


def preview(text: Column, chars: int = 84) -> Column:
    """White space single, cut to `chars` with an ellipsis; null for null and empty texts."""
    flat = squeeze(text)
    short = F.when(F.length(flat) <= chars, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, chars - 1)), F.lit("…")))
    return F.when(F.length(text) > 0, short)


def slug(text: Column, fallback: Column) -> Column:
    """URL-safe handle of at most 64 characters."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, 64), "-+$", "")
    return F.when(cut == "", fallback).otherwise(cut)


def identity_tokens(entities: Column, org_only: bool = False) -> Column:
    """Distinct `LABEL:value` tokens that name an actor; values lower case, generic collective nouns left out."""
    labels = ("ORG",) if org_only else IDENTITY_LABELS

    def value(e: Column) -> Column:
        return F.lower(F.trim(F.substring(e, F.instr(e, ":") + 1, F.length(e))))

    def keep(e: Column) -> Column:
        v = value(e)
        generic = F.arrays_overlap(F.split(v, f"{BLANK}+"), F.array(*[F.lit(w) for w in GENERIC_HEADS]))
        return e.isNotNull() & e.contains(":") & F.substring_index(e, ":", 1).isin(*labels) & v.rlike(r"\p{L}") & ~generic

    made = F.transform(F.filter(F.coalesce(entities, F.array().cast("array<string>")), keep), lambda e: F.concat(F.substring_index(e, ":", 1), F.lit(":"), value(e)))
    return F.array_distinct(made)


def entities_conflict(a: Column, b: Column) -> Column:
    """Both sides name actors and share none (token arrays)."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def like_literal(column: Column, query: str) -> Column:
    """Case-insensitive search for the literal text, `%` and `_` included."""
    return F.contains(F.lower(column), F.lit(query.lower()))
