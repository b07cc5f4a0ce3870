"""What depends on a language or a corpus: plain data that operators take as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LanguageProfile:
    """Letters and words of a language, as the operators need them."""

    vowels: str = "aeiouyäöüàâéèêëîïôùûœæáíóúñ"
    stopwords: frozenset[str] = field(default_factory=frozenset)
    openers: str = r"[«\"(—\p{Lu}0-9]"
    accents_from: str = "àâäáãéèêëíîïìóôöòõúûüùñçё"
    accents_to: str = "aaaaaeeeeiiiiooooouuuuncе"


LATIN = LanguageProfile()

#: Russian, for the phonetic rules of verse: vowels, and what a sound after the stress, a stressed one or a final one
#: becomes (fixed values).
RUSSIAN_VOWELS = "аеёиоуыэюя"
RUSSIAN_UNSTRESSED = ("оеяэюыё", "аиииуио")
RUSSIAN_STRESSED = ("яюеёы", "ауэои")
RUSSIAN_DEVOICED = ("бвгджз", "пфктшс")


@dataclass(frozen=True)
class Period:
    id: int
    low: int
    high: int
    label: str
