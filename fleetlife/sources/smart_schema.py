"""Telemetry schema generated from attribute id lists, in two spellings of the column names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Ids of the attributes in the daily files.
ATTRIBUTE_IDS = (
    1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 15, 16, 17, 22, 23, 24, 168, 170, 173, 174, 177, 179, 181, 182, 183, 184,
    187, 188, 189, 190, 191, 192, 193, 194, 195, 196, 197, 198, 199, 200, 201, 218, 220, 222, 223, 224, 225, 226, 231,
    232, 233, 235, 240, 241, 242, 250, 251, 252, 254, 255,
)
# Attributes that only solid-state devices report.
SOLID_STATE_IDS = frozenset({14, 15, 16, 17, 168, 173, 177, 179, 181, 182, 218, 231, 232, 233, 235, 255})
# Readable attribute names.
ATTRIBUTE_NAMES = {
    1: "Raw_Read_Error_Rate", 2: "Throughput_Performance", 3: "Spin_Up_Time", 4: "Start_Stop_Count",
    5: "Reallocated_Sector_Count", 7: "Seek_Error_Rate", 8: "Seek_Time_Performance", 9: "Power_On_Hours",
    10: "Spin_Retry_Count", 11: "Calibration_Retry_Count", 12: "Power_Cycle_Count", 13: "Read_Soft_Error_Rate",
    15: "User_Capacity", 16: "Spare_Blocks_Available", 17: "Remaining_Spare_Blocks", 22: "Current_Helium_Level",
    23: "Helium_Condition_Lower", 24: "Helium_Condition_Upper", 170: "Available_Reserved_Space", 173: "Erase_Count",
    174: "Unexpected_power_loss_count", 177: "Wear_Leveling_Count", 179: "Used_Reserved_Block_Count",
    181: "Non-4K_Aligned_Access_Count", 182: "Erase_Fail_Count", 183: "Runtime_Bad_Block", 184: "End-to-End_Error",
    187: "Reported_Uncorrectable_Errors", 188: "Command_Timeout", 189: "High_Fly_Writes",
    190: "Airflow_Temperature_Cel", 191: "G-Sense_Error_Rate", 192: "Power-Off_Retract_Count",
    193: "Load_Unload_Cycle", 194: "Temperature_Celsius", 195: "Hardware_ECC_Recovered",
    196: "Reallocated_Event_Count", 197: "Current_Pending_Sector_Count", 198: "Offline_Uncorrectable_Sector_Count",
    199: "UDMA_CRC_Error_Count", 200: "Multi_Zone_Error_Rate", 201: "Soft_Read_Error_Rate",
    218: "SSD_CRC_Error_Count", 220: "Disk_Shift", 222: "Loaded_Hours", 223: "Load_Retry_Count", 224: "Load_Friction",
    225: "Load_Cycle_Count", 226: "Load-in_Time", 231: "Life_Left", 232: "Available_Reserved_Space",
    233: "NAND_Writes_in_some_units", 240: "Head_Flying_Hours", 241: "Total_LBAs_Written", 242: "Total_LBAs_Read",
    250: "Read_Error_Retry_Rate", 251: "Minimum_Spares_Remaining", 252: "Newly_Added_Bad_Flash_Block",
    254: "Free_Fall_Sensor",
}

DISK_ATTRIBUTE_IDS = tuple(i for i in ATTRIBUTE_IDS if i not in SOLID_STATE_IDS)


def basic_name(attribute: int) -> str:
    return f"smart_{attribute}"


def pretty_name(attribute: int) -> str:
    """Readable name; attributes without one keep the basic spelling."""
    return ATTRIBUTE_NAMES.get(attribute, basic_name(attribute))


def _pair_fields(names: list[str]) -> list[T.StructField]:
    fields = []
    for name in names:
        fields.append(T.StructField(f"{name}_normalized", T.ShortType()))
        fields.append(T.StructField(f"{name}_raw", T.LongType()))
    return fields


def staging_schema(attributes: tuple[int, ...] = ATTRIBUTE_IDS) -> T.StructType:
    """Columns of the daily files: text keys, capacity, failure, then the attribute pairs."""
    head = [
        T.StructField("date", T.StringType()), T.StructField("serial_number", T.StringType()),
        T.StructField("model", T.StringType()), T.StructField("capacity_bytes", T.LongType()),
        T.StructField("failure", T.ShortType()),
    ]
    return T.StructType(head + _pair_fields([basic_name(a) for a in attributes]))


def fact_schema(attributes: tuple[int, ...] = DISK_ATTRIBUTE_IDS) -> T.StructType:
    """Columns of the normalised facts: device and day instead of text keys, readable attribute names."""
    head = [
        T.StructField("drive_id", T.LongType()), T.StructField("day", T.IntegerType()),
        T.StructField("capacity_bytes", T.LongType()), T.StructField("failure", T.ShortType()),
    ]
    return T.StructType(head + _pair_fields([pretty_name(a) for a in attributes]))


def prettify(df: DataFrame, attributes: tuple[int, ...] = DISK_ATTRIBUTE_IDS) -> DataFrame:
    """Rename ``smart_N_*`` columns to readable ones (only those present)."""
    return df.withColumnsRenamed({
        f"{basic_name(a)}_{part}": f"{pretty_name(a)}_{part}" for a in attributes for part in ("normalized", "raw")
    })
