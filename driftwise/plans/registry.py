"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from driftwise.plans import audit, problems, recovery, scans

QUERIES = {**problems.QUERIES, **audit.QUERIES, **recovery.QUERIES, **scans.QUERIES}
SQL = {**problems.SQL, **audit.SQL, **recovery.SQL, **scans.SQL}
