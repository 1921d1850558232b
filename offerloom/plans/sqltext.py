"""Small builders of oracle SQL for pattern rules (the oracle engine uses RE2 patterns)."""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]"


def re2(pattern: str) -> str:
    """The same rule for RE2: Unicode word characters, and a right boundary after accented letters."""
    inside = pattern.replace(r"[\w", r"[\p{L}\p{N}_")
    return inside.replace(r"[AÁ]\b", r"[AÁ](?:[^\p{L}\p{N}_]|$)").replace(r"\w", WORD)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def g(text: str, pattern: str, group: int = 1, ci: bool = True) -> str:
    """Group of the first match, NULL when there is none."""
    option = ", 'i'" if ci else ", 'c'"
    return f"nullif(regexp_extract({text}, {lit(re2(pattern))}, {group}{option}), '')"


def m(text: str, pattern: str, ci: bool = True) -> str:
    option = "'i'" if ci else "'c'"
    return f"regexp_matches({text}, {lit(re2(pattern))}, {option})"


def every(text: str, pattern: str, group: int = 1, ci: bool = True) -> str:
    option = ", 'i'" if ci else ", 'c'"
    return f"regexp_extract_all({text}, {lit(re2(pattern))}, {group}{option})"


def first(text: str, patterns: list, ci: bool = True) -> str:
    picks = [g(text, *(p if isinstance(p, tuple) else (p, 1)), ci) for p in patterns]
    return f"coalesce({', '.join(picks)}, null)"


def label(value: str, suffix: str = "", prefix: str = "") -> str:
    return f"({lit(prefix)} || {value} || {lit(suffix)})"


def amount(raw: str) -> str:
    return f"try_cast(replace(replace({raw}, '.', ''), ',', '.') as double)"


def money(raw: str, keep_raw: bool = True) -> str:
    shown = f"('$' || replace(format('{{:,}}', cast(round_even({amount(raw)}, 0) as bigint)), ',', '.'))"
    return f"coalesce({shown}, '$' || {raw})" if keep_raw else shown


def positive_money(text: str, patterns: list[str]) -> str:
    picks = [f"case when {amount(g(text, p))} > 0 then {money(g(text, p), False)} end" for p in patterns]
    return f"coalesce({', '.join(picks)}, null)"


def chain(text: str, rules: list[tuple[str, str]], ci: bool = False) -> str:
    return "case " + " ".join(f"when {m(text, p, ci)} then {lit(n)}" for p, n in rules) + " end"


def words(text: str, rules: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when contains({text}, {lit(p)}) then {lit(n)}" for p, n in rules) + " end"


def hits(text: str, rules: list[tuple[str, str]], ci: bool = False, sep: str = ", ") -> str:
    return "concat_ws(" + lit(sep) + ", " + ", ".join(f"case when {m(text, p, ci)} then {lit(n)} end" for p, n in rules) + ")"


def month(word: str) -> str:
    names = "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre']"
    clean = f"case when lower({word}) = 'setiembre' then 'septiembre' else lower({word}) end"
    return f"nullif(coalesce(list_position({names}, {clean}), 0), 0)"


def day(d: str, mo: str, y: str) -> str:
    """ISO text of a real date, else NULL."""
    year = f"case when length({y}) = 2 then '20' || {y} else lpad({y}, 4, '0') end"
    text = f"({year} || '-' || lpad(cast({mo} as varchar), 2, '0') || '-' || lpad({d}, 2, '0'))"
    return f"cast(try_cast({text} as date) as varchar)"


def last_day(iso: str) -> str:
    return f"cast(last_day(cast({iso} as date)) as varchar)"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
