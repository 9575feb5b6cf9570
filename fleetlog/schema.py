"""Names, groups and types of the columns of a fleet listing."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: column groups -------------------------------------------
AVG_COLS = ["disk_bw", "gpu_mem_bw", "pcie_bw", "dlperf", "inet_down", "inet_up", "score"]

HARDWARE_COLS = [
    "compute_cap", "total_flops", "cpu_cores", "cpu_name", "has_avx", "disk_name", "hosting_type",
    "mobo_name", "gpu_name", "num_gpus", "pci_gen", "gpu_lanes", "gpu_ram", "bw_nvlink",
]

EOD_COLS = [
    "cuda_max_good", "driver_version", "direct_port_count", "min_chunk", "verification", "end_date",
    "country", "isp", "public_ipaddr", "static_ip",
]

COST_COLS = [
    "dph_base", "storage_cost", "inet_up_cost", "inet_down_cost", "min_bid", "credit_discount_max",
]

ID_COLS = ["id", "host_id", "machine_id"]
SINGLE_COLS = ["timestamp", "cpu_ram", "disk_space", "reliability", "num_gpus_rented", "rented"]

STR_COLS = [
    "cpu_name", "cuda_max_good", "disk_name", "driver_version", "gpu_name", "mobo_name",
    "public_ipaddr", "country", "isp",
]

# Verification states and their codes.
VERIFICATION_CODES = {"unverified": 0, "verified": 1, "deverified": 2, "de-verified": 3}
# ---- end of fixed values ----------------------------------------------------

KEEP_COLS = AVG_COLS + HARDWARE_COLS + EOD_COLS + COST_COLS + ID_COLS + SINGLE_COLS
INT_COLS = [c for c in KEEP_COLS if c not in STR_COLS] + ["gpu_display_active"]

KEY = "machine_id"
TS = "timestamp"

# Change-log tables: name -> value columns.
LOG_TABLES = {
    "cpu_ram": ["cpu_ram"],
    "disk": ["disk_space"],
    "reliability": ["reliability"],
    "rent": ["num_gpus_rented"],
    "hardware": HARDWARE_COLS,
    "eod": EOD_COLS,
    "cost": COST_COLS,
}


def column_type(name: str) -> T.DataType:
    """Stored type of a listing column; unknown names are an error."""
    if name in STR_COLS:
        return T.StringType()
    if name in INT_COLS:
        return T.LongType()
    raise ValueError(f"unknown listing column: {name}")


_FLAGS = ["rented", "has_avx", "static_ip", "gpu_display_active"]
_KEYS = ["id", "host_id", "machine_id", "num_gpus"]


def _raw_type(name: str) -> T.DataType:
    if name in STR_COLS or name == "verification":
        return T.StringType()
    if name in _FLAGS:
        return T.BooleanType()
    if name in _KEYS:
        return T.LongType()
    return T.DoubleType()


def offer_schema() -> T.StructType:
    """One entry of a poll payload, in the units in which it arrives."""
    derived = {"country", "isp", "timestamp"}
    fields = [T.StructField(c, _raw_type(c)) for c in KEEP_COLS if c not in derived]
    fields += [
        T.StructField("rentable", T.BooleanType()),
        T.StructField("reliability2", T.DoubleType()),
        T.StructField("geolocation", T.StringType()),
        T.StructField(
            "location",
            T.StructType(
                [T.StructField("country", T.StringType()), T.StructField("isp", T.StringType())]
            ),
        ),
    ]
    return T.StructType(fields)


def payload_schema(offer: T.StructType | None = None) -> T.StructType:
    """Whole poll payload, with room for text that is not JSON."""
    return T.StructType(
        [
            T.StructField("timestamp", T.StringType()),
            T.StructField("offers", T.ArrayType(offer or offer_schema())),
            T.StructField("_corrupt_record", T.StringType()),
        ]
    )
