"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from typeweave.jobs import concordance, encoding, files, linkage, preparation, trees

MODULES = (concordance, encoding, files, linkage, preparation, trees)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
