"""name -> DuckDB SQL."""

from oracle import headers, items, notices, pages, tables, texts

ORACLES = {**items.SQL, **headers.SQL, **tables.SQL, **pages.SQL, **texts.SQL, **notices.SQL}
