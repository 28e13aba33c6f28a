"""Flow aggregation and the feature vector.

A packet table has packet_id, ts_us, src_ip, dst_ip, src_port, dst_port, protocol,
tcp_flags and bytes. Flows are directional, so backward counters are 0 unless
``bidirectional`` folds both directions into one flow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions import net
from packetloom.operators.prefix import MINUTE_US, attach

FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]

# Feature order, and the CSV columns the first 17 come from.
CSV_COLUMNS = {
    "destination_port": "Destination Port",
    "flow_duration_us": "Flow Duration",
    "total_fwd_packets": "Total Fwd Packets",
    "total_bwd_packets": "Total Backward Packets",
    "total_fwd_bytes": "Total Length of Fwd Packets",
    "total_bwd_bytes": "Total Length of Bwd Packets",
    "flow_bytes_per_s": "Flow Bytes/s",
    "flow_packets_per_s": "Flow Packets/s",
    "fwd_packets_per_s": "Fwd Packets/s",
    "bwd_packets_per_s": "Bwd Packets/s",
    "syn_flag_count": "SYN Flag Count",
    "ack_flag_count": "ACK Flag Count",
    "rst_flag_count": "RST Flag Count",
    "fin_flag_count": "FIN Flag Count",
    "psh_flag_count": "PSH Flag Count",
    "packet_length_mean": "Packet Length Mean",
    "packet_length_std": "Packet Length Std",
}
FEATURES = [*CSV_COLUMNS, "protocol_code"]
_FLAGS = {"syn": "S", "ack": "A", "rst": "R", "fin": "F", "psh": "P"}


def flag_bits(packets: DataFrame) -> DataFrame:
    """one 0/1 column per TCP flag."""
    return packets.withColumns(
        {f"{name}_flag": net.flag_bit(F.col("tcp_flags"), letter) for name, letter in _FLAGS.items()}
    )


def _measures(now: Column) -> dict[str, Column]:
    """Snapshot columns from the totals _n, _bytes, _squares and the start time."""
    seconds = F.greatest((now - F.col("start_us")) / 1e6, F.lit(1e-6))
    mean = F.col("_bytes") / F.col("_n")
    spread = F.col("_squares") / F.col("_n") - mean * mean
    zero = F.lit(0).cast("long")
    return {
        "destination_port": F.col("dst_port").cast("long"),
        "flow_duration_us": seconds * 1e6,
        "total_fwd_packets": F.col("_n"),
        "total_bwd_packets": zero,
        "total_fwd_bytes": F.col("_bytes"),
        "total_bwd_bytes": zero,
        "flow_bytes_per_s": F.col("_bytes") / seconds,
        "flow_packets_per_s": F.col("_n") / seconds,
        "fwd_packets_per_s": F.col("_n") / seconds,
        "bwd_packets_per_s": F.lit(0.0),
        **{f"{name}_flag_count": F.col(f"_{name}") for name in _FLAGS},
        "packet_length_mean": mean,
        "packet_length_std": F.sqrt(F.greatest(F.lit(0.0), spread)),
        "protocol_code": net.protocol_code(F.col("protocol")).cast("long"),
    }


def _packet_values() -> dict[str, Column]:
    size = F.col("bytes").cast("long")
    return {
        "_n": F.lit(1).cast("long"),
        "_bytes": size,
        "_squares": size.cast("double") * size.cast("double"),
        **{
            f"_{name}": net.flag_bit(F.col("tcp_flags"), letter).cast("long")
            for name, letter in _FLAGS.items()
        },
    }


def running_flows(
    packets: DataFrame, chunk: int = MINUTE_US, base: DataFrame | None = None
) -> DataFrame:
    """the state of its flow as each packet sees it, the packet included.

    ``base`` is a cheaper table of the same packets, if ``packets`` has costly columns.
    """
    values = _packet_values()
    ran = attach(
        packets, FLOW_KEY, "ts_us", sums=values, mins={"start_us": F.col("ts_us")},
        tiebreak="packet_id", chunk=chunk, base=base,
    )
    return ran.withColumns(_measures(F.col("ts_us"))).drop(*values)


def flows(packets: DataFrame, bidirectional: bool = False) -> DataFrame:
    """one record per flow, as its last packet leaves it.

    ``bidirectional`` names a flow by its first packet's direction and counts the other
    direction as backward.
    """
    values = _packet_values()
    if not bidirectional:
        totals = packets.groupBy(*FLOW_KEY).agg(
            F.min("ts_us").alias("start_us"),
            F.max("ts_us").alias("end_us"),
            *[F.sum(v).alias(n) for n, v in values.items()],
        )
        return totals.withColumns(_measures(F.col("end_us"))).drop(*values)

    here = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    there = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    ends = packets.withColumns({"_low": F.least(here, there), "_high": F.greatest(here, there)})
    ends = ends.withColumn("_forward", here == F.col("_low"))
    sides = [
        F.sum(F.when(F.col("_forward"), v).otherwise(0)).alias(f"_low{n}")
        for n, v in values.items() if n in ("_n", "_bytes")
    ]
    totals = ends.groupBy("_low", "_high", "protocol").agg(
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
        F.min_by("_forward", F.struct("ts_us", "packet_id")).alias("_low_first"),
        *sides,
        *[F.sum(v).alias(n) for n, v in values.items()],
    )
    first = F.col("_low_first")
    starter = F.when(first, F.col("_low")).otherwise(F.col("_high"))
    other = F.when(first, F.col("_high")).otherwise(F.col("_low"))
    named = totals.withColumns(
        {
            "src_ip": starter["ip"], "src_port": starter["port"],
            "dst_ip": other["ip"], "dst_port": other["port"],
        }
    )
    fwd_n = F.when(first, F.col("_low_n")).otherwise(F.col("_n") - F.col("_low_n"))
    fwd_b = F.when(first, F.col("_low_bytes")).otherwise(F.col("_bytes") - F.col("_low_bytes"))
    measured = named.withColumns({**_measures(F.col("end_us")), "_fwd": fwd_n, "_fwd_bytes": fwd_b})
    seconds = F.col("flow_duration_us") / 1e6
    return measured.withColumns(
        {
            "total_fwd_packets": F.col("_fwd"),
            "total_bwd_packets": F.col("_n") - F.col("_fwd"),
            "total_fwd_bytes": F.col("_fwd_bytes"),
            "total_bwd_bytes": F.col("_bytes") - F.col("_fwd_bytes"),
            "fwd_packets_per_s": F.col("_fwd") / seconds,
            "bwd_packets_per_s": (F.col("_n") - F.col("_fwd")) / seconds,
        }
    ).drop("_low", "_high", "_low_first", "_low_n", "_low_bytes", "_fwd", "_fwd_bytes", *values)


def flow_totals(packets: DataFrame) -> DataFrame:
    """packets and bytes per flow."""
    return packets.groupBy(*FLOW_KEY).agg(
        F.count("*").alias("packets"), F.sum(F.col("bytes").cast("long")).alias("bytes")
    )


def clean_value(value: Column) -> Column:
    """NULL, NaN and infinities become 0."""
    number = value.cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(bad, 0.0).otherwise(number)


def clean(df: DataFrame, cols: list[str]) -> DataFrame:
    """F5 over several columns."""
    return df.withColumns({c: clean_value(F.col(f"`{c}`")) for c in cols})


def feature_array(cols: list[str] = FEATURES) -> Column:
    """the cleaned features in their fixed order."""
    return F.array(*[clean_value(F.col(c)) for c in cols])


def features(df: DataFrame) -> DataFrame:
    """add the 18-value ``features`` array to flow snapshots."""
    return df.withColumn("features", feature_array())


def derive_protocol(df: DataFrame, map_numbers: bool = True) -> Column:
    """protocol code of a training CSV row.

    ``map_numbers`` turns IP protocol numbers into the codes of F8.
    """
    flags = [CSV_COLUMNS[f"{name}_flag_count"] for name in _FLAGS]
    if "Protocol" in df.columns:
        raw = F.col("Protocol").try_cast("double")
        if not map_numbers:
            return raw
        return F.when(raw == 6, 1.0).when(raw == 17, 2.0).when(raw == 1, 3.0).otherwise(0.0)
    if not set(flags) <= set(df.columns):
        return F.lit(1.0)
    total = sum((F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)) for c in flags), F.lit(0.0))
    return F.when(total > 0, 1.0).otherwise(2.0)


def features_from_csv(df: DataFrame, map_numbers: bool = True) -> DataFrame:
    """rename the training CSV columns to features; missing ones are all named."""
    missing = [c for c in CSV_COLUMNS.values() if c not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    kept = [c for c in df.columns if c not in CSV_COLUMNS.values() and c != "Protocol"]
    return df.select(
        *[F.col(f"`{c}`") for c in kept],
        *[clean_value(F.col(f"`{c}`").try_cast("double")).alias(f) for f, c in CSV_COLUMNS.items()],
        clean_value(derive_protocol(df, map_numbers)).alias("protocol_code"),
    )


def port_class(packets: DataFrame) -> DataFrame:
    """F9 and F11."""
    port = F.col("dst_port")
    return packets.withColumns(
        {
            "port_category": net.port_category(port),
            "unusual_port": net.unusual_port(port),
            "is_https": net.is_https(F.col("protocol"), port),
        }
    )
