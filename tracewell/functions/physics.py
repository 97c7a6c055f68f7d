"""Proxies of drive losses from currents, voltages, speed and torque."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import col

RPM_TO_RAD = 2.0 * math.pi / 60.0
MAGNITUDES = ("current", "voltage", "speed", "torque")


def add_physics_features(df: DataFrame) -> DataFrame:
    """Magnitudes, squared current, |u.i| and |torque * speed|."""
    i2 = F.col("i_d") * F.col("i_d") + F.col("i_q") * F.col("i_q")
    u2 = F.col("u_d") * F.col("u_d") + F.col("u_q") * F.col("u_q")
    return df.withColumns({
        "current_magnitude": F.sqrt(i2), "voltage_magnitude": F.sqrt(u2), "copper_loss_proxy": i2,
        "electrical_power_proxy": F.abs(F.col("u_d") * F.col("i_d") + F.col("u_q") * F.col("i_q")),
        "mechanical_power_proxy": F.abs(F.col("torque") * F.col("motor_speed"))})


def magnitudes(i_d="i_d", i_q="i_q", u_d="u_d", u_q="u_q", speed="speed_rpm", torque="torque_nm") -> dict[str, Column]:
    return {"current": F.hypot(col(i_d), col(i_q)), "voltage": F.hypot(col(u_d), col(u_q)),
            "speed": F.abs(col(speed)).cast("double"), "torque": F.abs(col(torque)).cast("double")}


def loss_proxies(current: Column, voltage: Column, speed: Column, torque: Column) -> Sequence[Column]:
    """Copper, frequency-weighted copper, electrical, mechanical and speed-squared losses."""
    return [current * current, current * current * speed, voltage * current,
            torque * speed * F.lit(RPM_TO_RAD), speed * speed]
