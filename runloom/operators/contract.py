"""What a model expects of its input, as the first stage of the model itself."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from runloom.functions import fixed


class InputContract(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Passes rows whose columns have the names and types the model was trained on; refuses others.

    Columns may come in any order and beside others: they leave in the contract's order, the others after
    them. Saved and loaded with the model it stands in, so the check holds wherever the model is used.
    """

    columns = Param(Params._dummy(), "columns", "schema of the expected columns, as JSON", TypeConverters.toString)
    example = Param(Params._dummy(), "example", "first rows the model was trained on, as JSON", TypeConverters.toString)

    @staticmethod
    def of(train: DataFrame, features: Sequence[str]) -> InputContract:
        """The contract of ``features``; at most ``EXAMPLE_ROWS`` rows are read for the example."""
        view = train.select(*features)
        rows = [r.asDict() for r in view.limit(fixed.EXAMPLE_ROWS).collect()]
        made = InputContract()
        return made._set(columns=view.schema.json(), example=json.dumps(rows, default=str))

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.getOrDefault(self.columns)))

    def example_rows(self) -> list[dict]:
        return json.loads(self.getOrDefault(self.example))

    def refusal(self, given: T.StructType) -> str | None:
        """Why rows of this schema are refused; None when they fit. Whether a column may be null does not matter."""
        want, have = self.schema(), {f.name: f.dataType for f in given}
        missing = [f.name for f in want if f.name not in have]
        if missing:
            return f"missing columns: {', '.join(missing)}"
        wrong = [
            f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}"
            for f in want
            if have[f.name].simpleString() != f.dataType.simpleString()
        ]
        return "; ".join(wrong) or None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        refused = self.refusal(dataset.schema)
        if refused:
            raise ValueError(refused)
        names = self.schema().names
        return dataset.select(*names, *[c for c in dataset.columns if c not in names])


def contract_of(model: PipelineModel) -> InputContract | None:
    """The contract a model carries, if any."""
    return next((s for s in model.stages if isinstance(s, InputContract)), None)
