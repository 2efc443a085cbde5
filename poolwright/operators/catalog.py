"""Several pools together: one for each model, queried by shared projections."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from poolwright.errors import ConfigError
from poolwright.operators.pool import Pool
from poolwright.schema import Model


class Trait:
    """Columns that rows of several models can be seen as."""

    def __init__(self, name: str, schema: T.StructType):
        self.name, self.schema = name, schema
        self._models: dict[str, Callable[[], dict[str, Column]]] = {}

    def implements(self, model: Model) -> Callable:
        """Decorator: the function gives the columns of the trait for ``model``;
        the first registration of a model stays."""

        def register(of: Callable[[], dict[str, Column]]):
            if not callable(of):
                raise ConfigError("a projection is a function")
            self._models.setdefault(model.name, of)
            return of

        return register

    def project(self, model: str, df: DataFrame) -> DataFrame:
        columns = self._models[model]()
        missing = set(self.schema.names) - set(columns)
        if missing:
            raise ConfigError(f"{model} lacks {', '.join(sorted(missing))} of {self.name}")
        return df.select(F.lit(model).alias("_model"), *(columns[f.name].cast(f.dataType).alias(f.name) for f in self.schema.fields))

    def union(self, frames: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
        """All rows of the models that implement the trait; UNION ALL."""
        parts = [self.project(name, frames[name]) for name in self._models if name in frames]
        empty = T.StructType([T.StructField("_model", T.StringType()), *self.schema.fields])
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], empty)


class Catalog:
    """Pools by model; registering a model again replaces its pool."""

    def __init__(self, spark: SparkSession):
        self.spark, self._pools = spark, {}

    def register(self, pool: Pool) -> Pool:
        self._pools[pool.model.name] = pool
        return pool

    def pool(self, model: Model | str) -> Pool | None:
        return self._pools.get(model if isinstance(model, str) else model.name)

    def all_of(self, trait: Trait) -> DataFrame:
        """Live rows of all registered pools, as the trait."""
        return trait.union({name: pool.dataframe() for name, pool in self._pools.items()}, self.spark)
