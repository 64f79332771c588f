"""SQL that gives the result of a registered query on the same tables."""

from __future__ import annotations


def statements() -> dict[str, str]:
    from oracle import statements_fields, statements_groups, statements_review

    out: dict[str, str] = {}
    for module in (statements_fields, statements_groups, statements_review):
        out.update(module.SQL)
    return out
