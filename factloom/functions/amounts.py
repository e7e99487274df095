"""Reading amounts: numbers in several notations and units that are written in many ways."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words before a number that don't change it.
QUALIFIERS = ("about", "approximately", "approx.", "approx", "around", "roughly", "circa", "ca.", "c.", "nearly", "almost", "some", "~", "≈", "put at", "amounting to")

_QUALIFIED = "|".join(re.escape(q) for q in QUALIFIERS)
_CURRENCY = r"(?:us\$|\p{Sc}|\b(?:eur|usd|gbp|dkk)\b)"


def states_amount(text: Column) -> Column:
    """True where a text states an amount: a number, perhaps after a qualifier, bracket, sign or currency. Null: false."""
    pattern = rf"(?iu)^[\s\p{{Z}}\"'“”*<(\[]*(?:(?:{_QUALIFIED})\s*)*[(]?\s*{_CURRENCY}?\s*[-+−]?\s*{_CURRENCY}?\s*[.,]?\d"
    return F.coalesce(text.rlike(pattern), F.lit(False))


#: Ways to write the units of unit_catalog, by base unit code. A currency is the base of its k, m and bn.
ALIASES: dict[str, tuple[str, ...]] = {
    "EUR": ("eur", "euro", "euros", "€"),
    "USD": ("usd", "us$", "us dollar", "us dollars", "dollar", "dollars", "$"),
    "GBP": ("gbp", "pound sterling", "pounds sterling", "£", "pound", "pounds"),
    "DKK": ("dkk", "danish krone", "danish kroner", "kroner"),
    "kg": ("kg", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes"),
    "t": ("t", "tonne", "tonnes", "metric ton", "metric tons", "ton", "tons"),
    "kt": ("kt", "kilotonne", "kilotonnes", "kiloton", "kilotons"),
    "lb": ("lb", "lbs", "pound", "pounds"),
    "kWh": ("kwh", "kilowatt hour", "kilowatt hours", "kilowatt-hour", "kilowatt-hours"),
    "MWh": ("mwh", "megawatt hour", "megawatt hours", "megawatt-hour", "megawatt-hours"),
    "GWh": ("gwh", "gigawatt hour", "gigawatt hours", "gigawatt-hour", "gigawatt-hours"),
    "TWh": ("twh", "terawatt hour", "terawatt hours", "terawatt-hour", "terawatt-hours"),
    "GJ": ("gj", "gigajoule", "gigajoules"),
    "m": ("m", "metre", "metres", "meter", "meters"),
    "km": ("km", "kilometre", "kilometres", "kilometer", "kilometers"),
    "mi": ("mi", "mile", "miles"),
    "nmi": ("nmi", "nm", "nautical mile", "nautical miles"),
    "l": ("l", "litre", "litres", "liter", "liters"),
    "m3": ("m3", "m³", "cbm", "cubic metre", "cubic metres", "cubic meter", "cubic meters"),
    "bbl": ("bbl", "bbls", "barrel", "barrels"),
    "percent": ("percent", "per cent", "pct", "%"),
    "bp": ("bp", "bps", "basis point", "basis points"),
    "ratio": ("ratio", "fraction"),
    "permille": ("permille", "per mille", "‰"),
    "month": ("month", "months", "mo", "mos"),
    "quarter": ("quarter", "quarters", "qtr", "qtrs"),
    "year": ("year", "years", "yr", "yrs"),
    "TEU": ("teu", "teus", "twenty-foot unit", "twenty-foot units", "twenty foot units"),
    "kTEU": ("kteu",),
    "FEU": ("feu", "feus", "forty-foot unit", "forty-foot units", "forty foot units"),
}
SCALES: dict[str, tuple[float, tuple[str, ...]]] = {
    "k": (1e3, ("k", "thousand", "'000", "’000", "000s", "tsd")),
    "m": (1e6, ("m", "mn", "mln", "million", "millions", "mio")),
    "bn": (1e9, ("bn", "bln", "billion", "billions", "mrd")),
}
_SCALE_OF = {a: (s, f) for s, (f, names) in SCALES.items() for a in names}

_NUMBER = re.compile(r"(?P<open>\()?(?P<sign>[-+−]?)(?P<digits>\d{1,3}(?:[    ]\d{3})+(?!\d)(?:[.,]\d+)?|\d[\d.,]*|[.,]\d+)(?:e(?P<exp>[-+−]?\d{1,3})(?!\d))?(?P<close>\))?", re.I)


@dataclass(frozen=True)
class Unit:
    """A unit as written: its scale ("" if none) and base ("" if only a scale is given)."""

    scale: str
    base: str


@dataclass(frozen=True)
class Number:
    readings: tuple[float, ...]  # the likeliest first
    start: int
    end: int


def readings(digits: str) -> tuple[float, ...]:
    """What digits with marks may mean, likeliest first. Of two kinds of marks the last is the decimal mark."""
    x = re.sub(r"[    ]", "", digits).rstrip(".,")
    dots, commas = x.count("."), x.count(",")
    if dots and commas:
        mark = "." if x.rfind(".") > x.rfind(",") else ","
        x = x.replace("," if mark == "." else ".", "")
        return (float(x.replace(mark, ".")),) if x.count(mark) == 1 else (float(x.replace(mark, "")),)
    if commas:
        if re.fullmatch(r"\d+(?:,\d{3})+", x):
            return (float(x.replace(",", "")),)
        return (float(x.replace(",", ".")),) if commas == 1 else (float(x.replace(",", "")),)
    if dots > 1:
        return (float(x.replace(".", "")),)
    return (float(x), float(x.replace(".", ""))) if re.fullmatch(r"[1-9]\d{0,2}\.\d{3}", x) else (float(x),)


def numbers(text: str) -> list[Number]:
    """All numbers of a text with their places. A number in round brackets is negative."""
    out = []
    at = 0
    while m := _NUMBER.search(text, at):
        at = m.end()
        before = text[m.start() - 1] if m.start() else " "
        if not m["sign"] and (before.isalnum() or before in "'’" and m["digits"] == "000"):
            continue  # Q3, FY21, '000
        if m["sign"] in ("-", "−") and before.isdigit():
            continue
        try:
            found = readings(m["digits"])
        except ValueError:
            continue
        sign = -1 if m["sign"] in ("-", "−") or m["open"] and m["close"] else 1
        scale = 10.0 ** int(m["exp"].replace("−", "-")) if m["exp"] else 1.0
        out.append(Number(tuple(sign * x * scale for x in found), m.start(), m.end()))
    return out


class UnitReader:
    """Finds units of a set of base codes beside a number or in a text of its own. A spelling may stand for several units."""

    def __init__(self, codes: Iterable[str]):
        self.base_of: dict[str, list[str]] = {}
        for c in codes:
            for a in ALIASES.get(c, (c.lower(),)):
                self.base_of.setdefault(a, []).append(c)
        base = "|".join(re.escape(a) for a in sorted(self.base_of, key=len, reverse=True))
        scale = "|".join(re.escape(a) for a in sorted(_SCALE_OF, key=len, reverse=True))
        stop = r"(?![^\W_])"
        self.after = re.compile(rf"[\s)\"'”*>]*?(?:(?P<s1>{scale})(?:\s+|(?=[^\w\s])))?(?P<b>{base}){stop}(?:\s*(?P<s2>{scale}){stop})?")
        self.joined = re.compile(rf"\s*(?P<b>[^\w\s']+|\w*\$)\s*(?P<s2>{scale}){stop}")
        self.scale = re.compile(rf"\s*(?P<s>{scale}){stop}")
        self.before = re.compile(rf"(?<![^\W_])(?P<b>{base})\s*$")

    def _units(self, scale: str | None, base: str) -> list[Unit]:
        found = [Unit(_SCALE_OF[scale][0] if scale else "", b) for b in self.base_of[base]]
        return found + [Unit(_SCALE_OF[base][0], "")] if base in _SCALE_OF and not scale else found  # m: metres or millions

    def beside(self, before: str, after: str) -> list[Unit]:
        """The units that may stand right after a number (texts in lower case), or the currency before it with the scale after it."""
        b = self.before.search(before[-24:])
        m = self.after.match(after)
        if m and not (b and m["b"] in _SCALE_OF):
            return self._units(m["s1"] or m["s2"], m["b"])
        m = self.joined.match(after)
        if m and m["b"] in self.base_of:
            return self._units(m["s2"], m["b"])
        s = self.scale.match(after)
        if b:
            return [Unit(_SCALE_OF[s["s"]][0] if s else "", c) for c in self.base_of[b["b"]]]
        return [Unit(_SCALE_OF[s["s"]][0], "")] if s else []

    def alone(self, text: str) -> list[Unit]:
        """The units that a whole text (in lower case) may be."""
        text = text.strip(" \t\n\"'“”*<>.!,;") if not text.strip().startswith(("'000", "’000")) else text.strip()
        for rx in (self.after, self.joined):
            m = rx.fullmatch(text)
            if m and m["b"] in self.base_of:
                return self._units(m["s2"] or m.groupdict().get("s1"), m["b"])
        return [Unit(_SCALE_OF[text][0], "")] if text in _SCALE_OF else []
