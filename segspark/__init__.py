"""segspark: image-segmentation data as Spark tables."""

from segspark.runtime import materialize, require_columns  # noqa: F401
