"""Shared column names, constants and StructTypes."""

from pyspark.sql import types as T

NOISE = -1
ROW_ID = "row_id"
CLUSTER = "cluster"
TRUTH = "true_label"
SEED = 42

# Fixed values that must equal the reference's: the text columns in imputation
# priority order, and the label column of the product JSON.
TEXT_COLS = ["Title", "ProductName", "Brand", "Description", "LongDesc"]
LABEL_COL = "Category.Name.Value"

PRODUCT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in TEXT_COLS]
    + [T.StructField(LABEL_COL, T.StringType(), True)]
)

LABELING_SCHEMA = T.StructType(
    [
        T.StructField(ROW_ID, T.LongType(), False),
        T.StructField(CLUSTER, T.IntegerType(), False),
    ]
)
