"""All queries of the library and their DuckDB twins."""

from __future__ import annotations

from . import answers as _answers  # noqa: F401, registers its queries
from . import catalogue as _catalogue  # noqa: F401
from . import library as _library  # noqa: F401
from . import more as _more  # noqa: F401
from . import places as _places  # noqa: F401
from . import queries as _queries
from . import retrieval as _retrieval  # noqa: F401
from . import runs as _runs  # noqa: F401
from . import sources as _sources  # noqa: F401


def queries():
    return dict(_queries.QUERIES)


def oracle_sql():
    return dict(_queries.SQL)
