"""Search parameters: wrong values fall back to defaults, never to errors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urlencode

from tabulary.functions.classify import DOC_TYPE_RULES, TOPIC_KEYWORDS

PAGE_SIZE = 20
TOPICS = tuple(dict.fromkeys(t for t, _, _ in TOPIC_KEYWORDS))
DOC_TYPES = (*dict.fromkeys(n for n, *_ in DOC_TYPE_RULES), "diger")
SORTS = ("yeni", "eski")
_ORDER = ("q", "konu", "tur", "kurum", "sirket", "yer", "yil", "baslangic", "bitis", "uzak", "sirala", "sayfa")


@dataclass
class SearchParams:
    q: str = ""
    konu: list[str] = field(default_factory=list)
    tur: list[str] = field(default_factory=list)
    kurum: str | None = None
    sirket: str | None = None
    yer: str | None = None
    yil: int | None = None
    baslangic: str | None = None
    bitis: str | None = None
    sirala: str = "yeni"
    sayfa: int = 1
    uzak: str | None = None

    @property
    def offset(self) -> int:
        return (self.sayfa - 1) * PAGE_SIZE

    def filters(self) -> int:
        """Chosen filters; a range counts once, the far-apart switch never."""
        one = [self.yil, self.baslangic or self.bitis, self.kurum, self.sirket, self.yer]
        return len(self.konu) + len(self.tur) + sum(map(bool, one))

    def address(self, path: str = "/ara") -> str:
        """Canonical address: fixed key order, defaults left out."""
        default = SearchParams()
        values = {k: getattr(self, k) for k in _ORDER if getattr(self, k) != getattr(default, k) and getattr(self, k)}
        text = urlencode({k: ",".join(v) if isinstance(v, list) else v for k, v in values.items()})
        return f"{path}?{text}" if text else path


def _one(value) -> str:
    return ((value[0] if value else "") if isinstance(value, list) else value or "").strip()


def _many(value, known: tuple[str, ...], most: int) -> list[str]:
    items = value if isinstance(value, list) else (value or "").split(",")
    items = [x.strip() for x in items if x.strip()]
    return items if len(items) <= most and all(x in known for x in items) else []


def _whole(text: str, low: int, high: int) -> int | None:
    return int(text) if re.fullmatch(r"\d{1,6}", text) and low <= int(text) <= high else None


def parse(raw: dict[str, str | list[str]]) -> SearchParams:
    """Parameters of an address; of repeated single values the first counts."""
    text = lambda k, most: x if 0 < len(x := _one(raw.get(k))) <= most else None
    day = lambda k: x if re.fullmatch(r"\d{4}-\d{2}-\d{2}", x := _one(raw.get(k))) else None
    return SearchParams(
        text("q", 200) or "", _many(raw.get("konu"), TOPICS, 8), _many(raw.get("tur"), DOC_TYPES, len(DOC_TYPES)), text("kurum", 120), text("sirket", 120), text("yer", 120),
        _whole(_one(raw.get("yil")), 1900, 2200), day("baslangic"), day("bitis"), x if (x := _one(raw.get("sirala"))) in SORTS else "yeni", _whole(_one(raw.get("sayfa")), 1, 500) or 1,
        "1" if _one(raw.get("uzak")) == "1" else None,
    )


#: Publishers and kinds of vacancy notices.
PUBLISHERS, VACANCY_KINDS = ("khk", "diger"), ("ilk_atama", "yukselme", "ogretmen")


def parse_topic(raw: dict[str, str | list[str]] | None) -> dict:
    """Parameters of a topic's feed: range, types, publisher, kind of notice and order; wrong values are dropped."""
    raw = raw or {}
    found = parse({k: raw[k] for k in ("baslangic", "bitis", "tur", "sirala") if k in raw})
    known = lambda k, values: x if (x := _one(raw.get(k))) in values else None
    return {"baslangic": found.baslangic, "bitis": found.bitis, "tur": found.tur, "yayinci": known("yayinci", PUBLISHERS), "ilan": known("ilan", VACANCY_KINDS), "sirala": found.sirala}
