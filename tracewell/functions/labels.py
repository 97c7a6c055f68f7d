"""Label grammars of record names, identifier rendering and name classification."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import col, number_token, trimmed_number

# Name grammars of the four record families, they must match published file names.
MACHINE_NAME = (r"(?i)^(\d+)W_(\d+)[_.](\d+)_(current|vibration)_(interturn|intercoil|coil)\.tdms$")
BENCH_HEALTHY_NAME = r"^HEALTHY_S(1200|1500|1800)_T(52|64|80)\.mat$"
BENCH_FAULT_NAME = (r"^FAULT_(TURNS|WINDINGS)_(D(?:0[1-9]|1[0-9]|2[0-4]))_(D(?:0[1-9]|1[0-9]|2[0-4]))"
                    r"_R(\d{3})_S(1200|1500|1800)_T(52|64|80)\.mat$")
TRANSIENT_NAME = (r"(?i)^(load_transient|steady_state|velocity_transient)_(1000|1200)_(\d+)turns?\.mat$")
DUAL_NAME = r"^spd10-5000rpm_flt(?:(0)z|([1-6])z([uv]))_(\d+(?:\.\d+)?)NM\.mat$"

# Phase current channels of the dual three-phase records.
CURRENT_CHANNELS = ("Currents_SubSys1_A", "Currents_SubSys1_B", "Currents_SubSys1_C",
                    "Currents_SubSys2_A", "Currents_SubSys2_B", "Currents_SubSys2_C")

# Winding position of each terminal in percent.
TERMINAL_POSITION = {
    "D01": 0.460, "D02": 2.310, "D03": 10.000, "D04": 12.500, "D05": 12.900, "D06": 14.800,
    "D07": 22.200, "D08": 25.000, "D09": 29.600, "D10": 32.400, "D11": 42.200, "D12": 44.900,
    "D13": 50.000, "D14": 52.300, "D15": 59.700, "D16": 61.600, "D17": 62.500, "D18": 64.800,
    "D19": 72.200, "D20": 74.100, "D21": 78.600, "D22": 82.400, "D23": 92.100, "D24": 94.900,
}

# Families of scale-free features.
SEQUENCE_FEATURES = ("sequence_unbalance", "zero_sequence_ratio", "phase_rms_cv")
SHAPE_FEATURES = ("fundamental_amplitude_cv", "clarke_radius_cv")


def _group(name: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(name, pattern, i)


def machine_labels(name: Column | str) -> Column:
    """Watts, severity, modality and family of a machine record; null for other names."""
    n = col(name)
    family = F.lower(_group(n, MACHINE_NAME, 5))
    family = F.when(family == "coil", "intercoil").otherwise(family)
    severity = F.concat(_group(n, MACHINE_NAME, 2), F.lit("."), _group(n, MACHINE_NAME, 3)).try_cast("double")
    watts = _group(n, MACHINE_NAME, 1).try_cast("int")
    motor = F.concat(trimmed_number(watts / 1000.0), F.lit("kW"))
    record = F.concat(motor, F.lit("_"), F.replace(family, F.lit("inter"), F.lit("")), F.lit("_"),
                      F.lower(_group(n, MACHINE_NAME, 4)), F.lit("_"), number_token(severity), F.lit("pct"))
    label = F.struct(watts.alias("motor_watts"), motor.alias("motor_id"), severity.alias("severity_percent"),
                     F.lower(_group(n, MACHINE_NAME, 4)).alias("modality"), family.alias("fault_family"),
                     (severity == 0).alias("is_healthy"), record.alias("record_id"))
    return F.when(n.rlike(MACHINE_NAME), label)


def bench_labels(name: Column | str) -> Column:
    """Speed, torque code, family, terminals and span of a bench record; null for other names."""
    n = col(name)
    healthy = n.rlike(BENCH_HEALTHY_NAME)
    a, b = _group(n, BENCH_FAULT_NAME, 2), _group(n, BENCH_FAULT_NAME, 3)
    faulty = n.rlike(BENCH_FAULT_NAME) & (a != b)

    def pick(i_healthy: int, i_fault: int) -> Column:
        return F.when(healthy, _group(n, BENCH_HEALTHY_NAME, i_healthy)).otherwise(_group(n, BENCH_FAULT_NAME, i_fault))

    label = F.struct(
        healthy.alias("is_healthy"), pick(1, 5).try_cast("int").alias("speed_rpm"),
        pick(2, 6).try_cast("int").alias("torque_code"),
        F.when(faulty, F.lower(_group(n, BENCH_FAULT_NAME, 1))).alias("fault_family"),
        F.when(faulty, a).alias("terminal_a"), F.when(faulty, b).alias("terminal_b"),
        F.when(faulty, _group(n, BENCH_FAULT_NAME, 4)).alias("resistance_code"))
    return F.when(healthy | faulty, label)


def transient_labels(path: Column | str) -> Column:
    """Motor, condition, setpoint and turns from 'folder/name'; null for anything else."""
    p = col(path)
    folder, n = F.lower(F.element_at(F.split(p, "/"), -2)), F.element_at(F.split(p, "/"), -1)
    small, large = folder == "200wmotor", folder == "20kwmotor"
    setpoint, turns = _group(n, TRANSIENT_NAME, 2).try_cast("int"), _group(n, TRANSIENT_NAME, 3).try_cast("int")
    designed = F.when(small, ((setpoint == 1000) & (turns == 4)) | ((setpoint == 1200) & turns.isin(2, 4, 6)))
    designed = designed.when(large, (setpoint == 1000) & turns.isin(1, 2, 3)).otherwise(F.lit(False))
    motor = F.when(small, "200W").otherwise("20kW")
    condition = F.lower(_group(n, TRANSIENT_NAME, 1))
    label = F.struct(
        motor.alias("motor_id"), condition.alias("condition"), setpoint.alias("setpoint"), turns.alias("fault_turns"),
        F.when(small, "a").otherwise("b").alias("fault_phase"),
        (turns / F.when(small, 25.0).otherwise(7.0)).alias("nominal_severity"),
        F.concat_ws("_", motor, condition, setpoint.cast("string"), F.concat(turns.cast("string"), F.lit("turn"))).alias("record_id"))
    return F.when(n.rlike(TRANSIENT_NAME) & designed, label)


def dual_labels(name: Column | str) -> Column:
    """Load, fault turns and phase of a dual three-phase record; null for other names."""
    n = col(name)
    healthy = _group(n, DUAL_NAME, 1) == "0"
    turns = F.when(healthy, F.lit(0)).otherwise(_group(n, DUAL_NAME, 2).try_cast("int"))
    phase = F.when(~healthy, _group(n, DUAL_NAME, 3))
    load = _group(n, DUAL_NAME, 4).try_cast("double")
    condition = F.concat(F.lit("flt"), turns.cast("string"), F.lit("z"), F.coalesce(phase, F.lit("")))
    record = F.concat(F.lit("external_dual_three_phase_"), condition, F.lit("_load_"), number_token(load), F.lit("nm"))
    label = F.struct(load.alias("load_nm"), turns.alias("fault_turns"), phase.alias("fault_phase"),
                     healthy.alias("is_healthy"), record.alias("record_id"))
    return F.when(n.rlike(DUAL_NAME), label)


#: Roles of recorded variables with their exact names and name prefixes; the first match counts.
VARIABLE_ROLES = [
    ("primary_abc_current", CURRENT_CHANNELS, []),
    ("dq_current_not_scored", [], ["Currents_SubSys"]),
    ("dq_control_voltage_not_scored", [], ["Voltage_SubSys"]),
    ("timebase", ["Time"], []),
    ("speed_qc_not_scored", [], ["Speed"]),
    ("electrical_position_not_scored", [], ["SinCos_Electrical"]),
]


def first_match(name: Column | str, table: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> Column:
    """Value of the first entry (value, names, prefixes) that fits the name; null when none does."""
    n = col(name)
    fits = [F.when(reduce(or_, [n.isin(*names)] * bool(names) + [n.startswith(p) for p in prefixes]), value) for value, names, prefixes in table]
    return F.coalesce(*fits)


def variable_role(name: Column | str) -> Column:
    """Role of a recorded variable in the audit."""
    return F.coalesce(first_match(name, VARIABLE_ROLES), F.lit("other"))


def parsed(df: DataFrame, name: str, grammar) -> tuple[DataFrame, DataFrame]:
    """Split into labelled rows and a quarantine of rows whose name does not parse."""
    tagged = df.withColumn("_label", grammar(name))
    good = tagged.filter(F.col("_label").isNotNull()).select(*df.columns, "_label.*")
    return good, df.filter(grammar(name).isNull())


def terminal_span(a: Column | str, b: Column | str) -> Column:
    """Distance of two terminals along the winding in percent."""
    entries = [F.lit(v) for pair in TERMINAL_POSITION.items() for v in pair]
    table = F.create_map(*entries)
    return F.abs(table[col(a)] - table[col(b)])


#: Diagnostic families of scale-free features with their exact names and name prefixes; the first match counts.
FEATURE_FAMILIES = [
    ("speed_proxy", ["fundamental_hz"], []),
    ("spectral_entropy", ["spectral_entropy"], []),
    ("harmonic_sideband", ["thd_2_to_5_mean"], ["harmonic_", "sideband_"]),
    ("sequence_imbalance", SEQUENCE_FEATURES, []),
    ("current_shape", SHAPE_FEATURES, ["crest_", "kurtosis_", "rms_ratio_"]),
]


def feature_family(name: Column | str) -> Column:
    """Diagnostic family of a scale-free feature; null when unknown."""
    return first_match(name, FEATURE_FAMILIES)
