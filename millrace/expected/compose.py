"""Put the CTEs a text needs in front of it."""

from __future__ import annotations

import re

from millrace.sources.feeds import FEEDS
from millrace.expected.curated import CURATED

KNOWN = {**FEEDS, **CURATED}


def _needs(sql: str, known: dict[str, str]) -> list[str]:
    return [n for n in known if re.search(rf"\b{n}\b", sql)]


def compose(sql: str, **extra: str) -> str:
    """``sql`` with every named feed, curated table or ``extra`` CTE it reaches, in order of dependency."""
    known = {**KNOWN, **extra}
    done: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text, known):
            if name not in done:
                body = known[name]
                visit(body)
                if name not in done:
                    done.append(name)

    visit(sql)
    if not done:
        return sql
    ctes = ",\n".join(f"{n} AS ({known[n].strip()})" for n in done)
    return f"WITH {ctes}\n{sql}"
