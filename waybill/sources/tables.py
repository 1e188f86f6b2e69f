"""The set of source tables a plan reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from waybill.operators.skew import frequent_keys
from waybill.schemas import SOURCE_SCHEMAS


class Sources:
    """One DataFrame per logical source, as an attribute; see ``schemas.SOURCE_SCHEMAS``.

    A source may be given as a function, which is called when the source is first used,
    so that a plan opens only what it reads.  ``hot_keys`` may name, per table, the orders that own very many of its rows and
    over how many copies each is dealt;
    a table that is not in it is looked through once, when first needed.
    """

    def __init__(self, hot_keys: dict[str, dict] | None = None, bucketed: bool = False, **tables: DataFrame | Callable[[], DataFrame]):
        if tables.keys() != SOURCE_SCHEMAS.keys():
            raise TypeError(f"the sources are {', '.join(SOURCE_SCHEMAS)}")
        # Whether rows of an order stand together in all its tables, so that they join in place.
        self.bucketed = bucketed
        self.hot_keys = {} if hot_keys is None else hot_keys
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("_tables", {})
        if name not in tables:
            raise AttributeError(name)
        df = tables[name]
        self.__dict__[name] = df() if callable(df) else df
        return self.__dict__[name]

    def hot_orders(self, table: str) -> dict:
        """Orders that own a large share of ``table``; looked up once per set."""
        if table not in self.hot_keys:
            self.hot_keys[table] = frequent_keys(getattr(self, table), "order_id")
        return self.hot_keys[table]
