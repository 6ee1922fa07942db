"""Canonical language codes from labels written in many ways, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code, three-letter codes and names under which a label may name the language.
LANGUAGES = {
    "en": ("eng", "english"),
    "es": ("spa", "spanish", "espanol", "español", "castilian", "castellano"),
    "pt": ("por", "portuguese", "portugues", "português"),
    "fr": ("fra", "fre", "french", "francais", "français"),
    "de": ("deu", "ger", "german", "deutsch"),
    "it": ("ita", "italian", "italiano"),
    "nl": ("nld", "dut", "dutch", "nederlands", "flemish"),
    "sv": ("swe", "swedish", "svenska"),
    "pl": ("pol", "polish", "polski"),
    "tr": ("tur", "turkish", "türkçe", "turkce"),
    "ru": ("rus", "russian", "русский"),
    "ja": ("jpn", "japanese", "日本語"),
    "af": ("afr", "afrikaans"),
    "ar": ("ara", "arabic"),
    "az": ("aze", "azerbaijani"),
    "bg": ("bul", "bulgarian"),
    "br": ("bre", "breton"),
    "ca": ("cat", "catalan", "valencian"),
    "cs": ("ces", "cze", "czech"),
    "da": ("dan", "danish"),
    "el": ("ell", "gre", "greek"),
    "et": ("est", "estonian"),
    "eu": ("eus", "baq", "basque"),
    "fa": ("fas", "per", "persian", "farsi"),
    "fi": ("fin", "finnish"),
    "ga": ("gle", "irish"),
    "gl": ("glg", "galician"),
    "he": ("heb", "hebrew"),
    "hi": ("hin", "hindi"),
    "hr": ("hrv", "croatian"),
    "ht": ("hat", "haitian creole"),
    "hu": ("hun", "hungarian"),
    "id": ("ind", "indonesian"),
    "is": ("isl", "ice", "icelandic"),
    "ko": ("kor", "korean"),
    "la": ("lat", "latin"),
    "lt": ("lit", "lithuanian"),
    "lv": ("lav", "latvian"),
    "ms": ("msa", "may", "malay"),
    "nn": ("nno", "nynorsk"),
    "no": ("nor", "nb", "nob", "norwegian", "bokmål"),
    "ro": ("ron", "rum", "romanian"),
    "sk": ("slk", "slo", "slovak"),
    "sl": ("slv", "slovenian"),
    "sr": ("srp", "serbian"),
    "sw": ("swa", "swahili"),
    "th": ("tha", "thai"),
    "tl": ("tgl", "tagalog", "filipino"),
    "uk": ("ukr", "ukrainian"),
    "vi": ("vie", "vietnamese"),
    "yo": ("yor", "yoruba"),
}

#: Labels that say that the language isn't known.
PLACEHOLDERS = ("", "unknown", "und", "unk", "none", "null", "nan", "n/a", "na", "?", "??", "-", "xx", "zz", "zxx", "mul", "other", "auto", "undefined", "undetermined")


def canonical_language(label: Column) -> Column:
    """Two-letter code of a label; 'other:<text>' for a name not known here; NULL for no language.

    Case, spaces, regions and scripts after ``-`` or ``_`` and three-letter codes don't matter.
    """
    clean = F.lower(F.trim(F.regexp_replace(label, r"[\s ﻿]+", " ")))
    head = F.regexp_extract(clean, r"^([^-_ (]*)", 1)
    known = {n: code for code, names in LANGUAGES.items() for n in (code, *names)}
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    code = F.coalesce(F.element_at(pairs, clean), F.element_at(pairs, head))
    nothing = clean.isNull() | clean.isin(*PLACEHOLDERS) | ~clean.rlike(r"\p{L}")
    return F.when(nothing, F.lit(None).cast("string")).otherwise(F.coalesce(code, F.concat(F.lit("other:"), clean)))
