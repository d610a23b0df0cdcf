"""Fixed schemas.  They are built without a session, so Python workers can import them."""

from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType


def _schema(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


TICK_RAW = _schema(
    trade_id=LongType(), price=StringType(), quantity=StringType(), quote_quantity=StringType(), timestamp=LongType(), is_buyer_maker=StringType(), is_best_match=StringType()
)
TICK = _schema(timestamp=TimestampNTZType(), price=DoubleType(), quantity=DoubleType(), quote_quantity=DoubleType(), isBuyerMaker=BooleanType(), trade_id=LongType())
