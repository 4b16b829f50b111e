"""The encounter model over an order-style star schema.

lineitem is the admission fact; orders, supplier, part and customer supply its attributes. Only the
dimensions that the requested columns need are joined. All of them are LEFT joins on a unique key, so
leaving one out never changes the rows. Customer attributes (the patient's age and gender too) are attached
to orders first: the fact is then shuffled once for both, and never by customer. Doctor attributes come with
the supplier.

The optimizer estimates a join of two dimensions by the product of their sizes and would shuffle the fact
for it. So a joined dimension whose files are below the session's broadcast threshold is marked for
broadcast here; a larger one is left to a shuffled join, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import cents
from ..session import file_bytes, stage_parts

_BILL = "l_extendedprice"

# Bytes of lineitem's files that are joined at a time where the joined fact is staged: every join is a shuffle of the
# fact, and the shuffle files of one part go before the next begins.
PART_BYTES = 512 << 20


def _covered_cents() -> Column:
    # Percent of the bill, rounded half up to a cent, in integer arithmetic.
    percent = F.rint(F.col("l_discount") * 100).cast("long")
    return F.call_function("div", cents(_BILL) * percent + F.lit(50), F.lit(100).cast("long"))


def _admission_id() -> Column:
    """All columns of the row; lineitem has no key of fewer."""
    hundredths = ("l_extendedprice", "l_discount", "l_tax")
    return F.concat_ws(
        "-",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").cast("int"),
        *(cents(c) for c in hundredths),
        "l_returnflag",
        "l_linestatus",
        F.unix_date(F.to_date("l_shipdate")),
    )


def _age() -> Column:
    return F.floor((F.col("c_acctbal") + 1000) / 130).cast("int")


def _gender() -> Column:
    return F.when(F.col("c_custkey") % 2 == 0, "Female").when(F.col("c_custkey").isNotNull(), "Male")


def _experience() -> Column:
    return (F.col("s_suppkey") % 23 + 3).cast("int")


# logical column -> (dimensions it needs, expression)
_ADMISSION_COLUMNS = {
    "admission_id": ((), _admission_id),
    "patient_id": (("orders",), lambda: F.col("o_custkey")),
    "doctor_id": ((), lambda: F.col("l_suppkey")),
    "department_name": (("supplier",), lambda: F.col("s_nation")),
    "diagnosis": (("part",), lambda: F.col("p_brand")),
    "admission_date": ((), lambda: F.to_date("l_shipdate")),
    "length_of_stay": ((), lambda: F.col("l_quantity").cast("int")),
    "severity": (("orders",), lambda: F.col("o_orderpriority")),
    "total_bill": ((), lambda: F.col(_BILL)),
    "insurance_provider": (("orders", "customer"), lambda: F.col("c_region")),
    "insurance_covered": ((), lambda: _covered_cents() / F.lit(100.0)),
    "patient_paid": ((), lambda: (cents(_BILL) - _covered_cents()) / F.lit(100.0)),
    "readmitted_30days": ((), lambda: (F.col("l_returnflag") == "R").cast("int")),
    "bed_type": (("orders", "customer"), lambda: F.col("c_mktsegment")),
    "admission_type": (("orders",), lambda: F.col("o_orderstatus")),
    "outcome": ((), lambda: F.when(F.col("l_linestatus") == "F", "Recovered").otherwise("Referred")),
    "age": (("orders", "customer"), _age),
    "gender": (("orders", "customer"), _gender),
    "doctor_name": (("supplier",), lambda: F.col("s_name")),
    "specialization": (("supplier",), lambda: F.col("s_nation")),
    "experience_years": (("supplier",), _experience),
}

# logical column -> the columns of the tables that it is made of, where these are others than its own
_RAW_COLUMNS = {
    "admission_id": (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", _BILL, "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ),
    "patient_id": ("o_custkey",),
    "doctor_id": ("l_suppkey",),
    "department_name": ("s_nation",),
    "diagnosis": ("p_brand",),
    "admission_date": ("l_shipdate",),
    "length_of_stay": ("l_quantity",),
    "severity": ("o_orderpriority",),
    "total_bill": (_BILL,),
    "insurance_provider": ("c_region",),
    "insurance_covered": (_BILL, "l_discount"),
    "patient_paid": (_BILL, "l_discount"),
    "readmitted_30days": ("l_returnflag",),
    "bed_type": ("c_mktsegment",),
    "admission_type": ("o_orderstatus",),
    "outcome": ("l_linestatus",),
    "age": ("c_acctbal",),
    "gender": ("c_custkey",),
    "doctor_name": ("s_name",),
    "specialization": ("s_nation",),
    "experience_years": ("s_suppkey",),
}

_PROCEDURE_COLUMNS = {
    "procedure_id": _admission_id,
    "admission_id": lambda: F.col("l_orderkey"),
    "department_name": lambda: F.col("s_nation"),
    "procedure_name": lambda: F.col("p_type"),
    "cost": lambda: F.col(_BILL),
}

_SALE_COLUMNS = {
    "sale_date": lambda: F.to_date("o_orderdate"),
    "amount": lambda: F.col("o_totalprice"),
    "region": lambda: F.col("c_region"),
}


class StarTables:
    """Encounter tables over one folder of star-schema Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        # Every inference starts a job that reads footers; kept for this object only, as tables may change.
        self._schemas: dict[str, StructType] = {}

    def raw(self, table: str) -> DataFrame:
        path = f"{self.folder}/{table}.parquet"
        if path not in self._schemas:
            self._schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[path]).parquet(path)

    def _broadcast_if_small(self, dimension: DataFrame, *tables: DataFrame) -> DataFrame:
        """Mark a dimension built from the given tables, if their files together are small enough."""
        limit = self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        if sum(map(file_bytes, tables)) <= limit:
            return F.broadcast(dimension)
        return dimension

    def _nation(self) -> DataFrame:
        return self.raw("nation").select("n_nationkey", "n_name", "n_regionkey")

    def _supplier(self) -> DataFrame:
        supplier = self.raw("supplier")
        nation = self._nation()
        joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left").select(
            "s_suppkey", "s_name", F.col("n_name").alias("s_nation")
        )
        return self._broadcast_if_small(joined, supplier)

    def _customer(self) -> DataFrame:
        customer = self.raw("customer")
        nation = self._nation()
        region = self.raw("region")
        joined = (
            customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
            .join(region, nation.n_regionkey == region.r_regionkey, "left")
            .select(
                "c_custkey",
                "c_acctbal",
                "c_mktsegment",
                F.col("n_name").alias("c_nation"),
                F.col("r_name").alias("c_region"),
            )
        )
        return self._broadcast_if_small(joined, customer)

    def _orders_with_customer(self) -> DataFrame:
        orders, customer = self.raw("orders"), self._customer()
        return orders.join(customer, orders.o_custkey == customer.c_custkey, "left")

    def _joined(self, columns: Iterable[str], fact: DataFrame) -> DataFrame:
        """The fact with the dimensions that the given logical columns need."""
        needs = {dim for c in columns for dim in _ADMISSION_COLUMNS[c][0]}
        if "orders" in needs:
            orders = self.raw("orders")
            if "customer" in needs:
                orders = self._broadcast_if_small(
                    self._orders_with_customer(), orders, self.raw("customer")
                )
            fact = fact.join(orders, fact.l_orderkey == orders.o_orderkey, "left")
        if "supplier" in needs:
            supplier = self._supplier()
            fact = fact.join(supplier, fact.l_suppkey == supplier.s_suppkey, "left")
        if "part" in needs:
            part = self.raw("part")
            fact = fact.join(part, fact.l_partkey == part.p_partkey, "left")
        return fact

    def admissions(self, *columns: str) -> DataFrame:
        """The admission fact with the given logical columns."""
        fact = self._joined(columns, self.raw("lineitem"))
        return fact.select(*[_ADMISSION_COLUMNS[c][1]().alias(c) for c in columns])

    def staged_admissions(self, *columns: str) -> DataFrame:
        """The same rows, joined and staged once, a part of the fact after the other where it is large.

        The columns of the tables are staged, which take less room than an admission_id made of eleven of them.
        """
        fact = self.raw("lineitem")
        n = max(1, -(-file_bytes(fact) // PART_BYTES))
        raw = list(dict.fromkeys(r for c in columns for r in _RAW_COLUMNS[c]))
        part = F.pmod(F.xxhash64("l_orderkey"), F.lit(n))
        facts = [fact.where(part == i) for i in range(n)] if n > 1 else [fact]
        staged = stage_parts(self._joined(columns, own).select(*raw) for own in facts)
        return staged.select(*[_ADMISSION_COLUMNS[c][1]().alias(c) for c in columns])

    def patients(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("patient_id"),
            _age().alias("age"),
            _gender().alias("gender"),
        )

    def doctors(self) -> DataFrame:
        return self._supplier().select(
            F.col("s_suppkey").alias("doctor_id"),
            F.col("s_name").alias("doctor_name"),
            F.col("s_nation").alias("specialization"),
            _experience().alias("experience_years"),
        )

    def order_admissions(self) -> DataFrame:
        """Orders as admissions, the parents of procedures()."""
        return self._orders_with_customer().select(
            F.col("o_orderkey").alias("admission_id"), F.col("c_nation").alias("department_name")
        )

    def procedures(self, *columns: str) -> DataFrame:
        """lineitem rows as procedures of an order, with the given logical columns."""
        fact = self.raw("lineitem")
        if "procedure_name" in columns:
            part = self.raw("part")
            fact = fact.join(part, fact.l_partkey == part.p_partkey, "left")
        if "department_name" in columns:
            supplier = self._supplier()
            fact = fact.join(supplier, fact.l_suppkey == supplier.s_suppkey, "left")
        return fact.select(*[_PROCEDURE_COLUMNS[c]().alias(c) for c in columns])

    def sales(self, *columns: str) -> DataFrame:
        """Orders as sales: sale_date, amount, region."""
        orders = self._orders_with_customer() if "region" in columns else self.raw("orders")
        return orders.select(*[_SALE_COLUMNS[c]().alias(c) for c in columns])

    def schedule(self) -> DataFrame:
        """Events as a schedule: an event type is a station, a user is a train."""
        return self.raw("events").select(
            F.col("event_type").alias("station"),
            F.col("user_id").alias("train"),
            F.to_date("ts").alias("day"),
        )
