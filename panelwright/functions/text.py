"""Text expressions: encoding repair, transliteration, topic patterns, page text."""
from __future__ import annotations

import html
import sys
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CYRILLIC = "[а-яА-ЯёЁ]"

# fixed values: Latin spelling of each letter
TRANSLIT = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "j",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "cz", "ч": "ch", "ш": "sh", "щ": "shh", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "ju", "я": "ja",
}

# fixed values: word roots per topic, roots that may sit inside a compound, and the roots used before
TOPICS = {
    "ceny": ["cen(?!tr)", "czen(?!tr)", "tsen(?!tr)", "podorozh", "infl", "deshev", "tarif"],
    "dohody": ["zarplat", "dohod", "pensi", "vyplat", "posobi"],
    "zanjatost": ["rabot", "uvol", "vakans", "sokrash", "bezrabot"],
    "proizvodstvo": ["zavod", "predprijati", "proizvodstv", "fabrik", "cekh", "ceh"],
    "kredit": ["kredit", "ipotek", "bank(?!et)", "dolg(?!o(?!v)|ovrem|ovech)", "stavk"],
    "torgovlja": ["magazin", "torgov", "rynok", "rynk", "otkry", "zakry"],
}
RATE_TOPIC = {
    "dkp": ["\\bczb\\b", "czentrobank", "kljuchev", "nabiullin", "(?<!gazo)reguljator", "stavk", "infljacz", "proczentn"],
}
NATIONAL_TOPICS = TOPICS | RATE_TOPIC
COMPOUND_ROOTS = {
    "zavod", "fabrik", "proizvodstv", "predprijati", "bank(?!et)", "(?<!gazo)reguljator", "deshev", "vyplat", "ipotek",
    "dolg(?!o(?!v)|ovrem|ovech)", "magazin", "rynok", "rynk",
}
LEGACY_TOPICS = {
    "ceny": ["cen", "czen", "tsen", "podorozh", "infl", "deshev", "tarif"],
    "dohody": ["zarplat", "dohod", "pensi", "vyplat", "posobi"],
    "zanjatost": ["rabot", "uvol", "vakans", "sokrash", "bezrabot"],
    "proizvodstvo": ["zavod", "predprijati", "proizvodstv", "fabrik", "cekh", "ceh"],
    "kredit": ["kredit", "ipotek", "bank", "dolg", "stavk"],
    "torgovlja": ["magazin", "torgov", "rynok", "rynk", "otkry", "zakry"],
    "dkp": ["\\bczb\\b", "czentrobank", "kljuchev", "nabiullin", "reguljator", "stavk", "infljacz", "proczentn"],
}


def repair_encoding(text: Column) -> Column:
    """UTF-8 once read as Latin-1 is put right, but only where that brings up Cyrillic."""
    narrow = ~text.rlike("[^\\u0000-\\u00ff]")
    raw = F.when(~text.rlike(CYRILLIC) & narrow, F.encode(text, "ISO-8859-1"))
    candidate = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.when(candidate.rlike(CYRILLIC), candidate).otherwise(text)


def transliterate(text: Column, table: Mapping[str, str] = TRANSLIT) -> Column:
    """Lower case, letter for letter; letters that map to nothing vanish."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    gone = [k for k, v in table.items() if not v]
    out = F.translate(F.lower(text), "".join([*single, *gone]), "".join(single.values()))
    for letter, spelling in table.items():
        if len(spelling) > 1:
            out = F.replace(out, F.lit(letter), F.lit(spelling))
    return out


def topic_pattern(roots: Iterable[str], compound: Iterable[str] = COMPOUND_ROOTS) -> str:
    """One regex per topic: a root starts a word unless it may sit inside one or brings its own boundary."""
    inside = set(compound)
    free = [r.startswith("\\b") or r in inside for r in roots]
    return "|".join(root if ok else f"(?<![a-z]){root}" for root, ok in zip(roots, free))


def topic_flags(norm: Column, topics: Mapping[str, Sequence[str]], compound: Iterable[str] = COMPOUND_ROOTS) -> dict[str, Column]:
    return {f"t_{t}": F.coalesce(norm.rlike(topic_pattern(roots, compound)), F.lit(False)) for t, roots in topics.items()}


@F.pandas_udf(ArrayType(StringType()))
def _unescape(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda parts: None if parts is None else [html.unescape(p) for p in parts])


def page_text(page: Column, max_chars: int | None = None, min_chars: int = 40) -> Column:
    """Paragraphs of a page: scripts and tags removed, entities resolved, short ones dropped."""
    bare = F.regexp_replace(page, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    blocks = F.regexp_extract_all(bare, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    plain = _unescape(F.transform(blocks, lambda b: F.regexp_replace(b, "<[^>]+>", " ")))
    clean = F.transform(plain, lambda b: F.regexp_replace(F.regexp_replace(b, r"(?U)\s+", " "), "^ | $", ""))
    text = F.array_join(F.filter(clean, lambda b: F.length(b) >= min_chars), " ")
    return text if max_chars is None else F.substring(text, 1, max_chars)


def title_from_slug(url: Column) -> Column:
    """Last path element without trailing digits, dashes as spaces."""
    path = F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1), "/+$", "")
    slug = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(slug, r"\d+$", ""), "[-_]+", " "))
