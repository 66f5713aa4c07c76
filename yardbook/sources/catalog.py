"""A lazy set of named tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

Loader = Callable[["Catalog"], DataFrame]


class Catalog(Mapping[str, DataFrame]):
    """Named DataFrames, each built on first use.

    ``sources`` are stored tables. A derived table that is not stored is computed by the operator
    that defines it, so every operator can name any table.
    """

    def __init__(self, spark: SparkSession, sources: Mapping[str, DataFrame | Loader]):
        self.spark = spark
        self._loaders = dict(sources)
        self._built: dict[str, DataFrame] = {}

    def stored(self, name: str) -> bool:
        """Whether the table is a source rather than derived on demand."""
        return name in self._loaders

    def sources(self) -> list[str]:
        """Names of the source tables."""
        return list(self._loaders)

    def with_tables(self, **tables: DataFrame | Loader) -> "Catalog":
        """A copy with some tables replaced or added."""
        return Catalog(self.spark, {**self._loaders, **tables})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            loader = self._loaders.get(name) or _derived().get(name)
            if loader is None:
                raise KeyError(name)
            self._built[name] = loader if isinstance(loader, DataFrame) else loader(self)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter({**_derived(), **self._loaders})

    def __len__(self) -> int:
        return len({**_derived(), **self._loaders})

    def register_views(self, prefix: str = "") -> None:
        """Expose every table to SQL under its own name."""
        for name in self:
            self[name].createOrReplaceTempView(prefix + name)


def _derived() -> dict[str, Loader]:
    from yardbook.operators import billing, exceptions, forecast, profit, revenue, tax

    return {
        "revenue_engine": revenue.revenue_engine,
        "earned_terms": billing.earned_terms,
        "billing_terms": billing.billing_terms,
        "wip_summary": billing.wip_summary,
        "job_profit": profit.job_profit_table,
        "asset_profit": profit.asset_profit_table,
        "forecast_assumptions": forecast.forecast_assumptions,
        "myob_gl_extract": tax.gl_extract,
        "bas_check": tax.bas_check_lines,
        "dated_withholding": tax.dated_withholding,
        "exception_log": exceptions.exception_log_build,
    }
