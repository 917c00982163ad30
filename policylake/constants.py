"""Fixed values of the domain: column lists, code tables, catalogues and default parameters.

Everything here is a value that results depend on, stated plainly.
"""

from __future__ import annotations

# --- fixed values: slice and scheduler codes -------------------------------------------------
SLICES = {0: "eMBB", 1: "mMTC", 2: "URLLC"}
SLICE_NAMES = ["eMBB", "mMTC", "URLLC"]
SCHEDULERS = {0: "round_robin", 1: "waterfilling", 2: "proportional_fair"}
MAX_PRB = 275

# --- fixed values: state vector of a one-second measurement ----------------------------------
STATE_COLUMNS = [
    "num_ues",
    "slice_prb",
    "power_multiplier",
    "scheduler_code",
    "dl_mcs",
    "dl_buffer_bytes",
    "dl_bitrate_mbps",
    "dl_errors_pct",
    "dl_cqi",
    "ul_mcs",
    "ul_buffer_bytes",
    "ul_bitrate_mbps",
    "ul_errors_pct",
    "ul_sinr",
    "requested_prbs",
    "granted_prbs",
    "grant_ratio",
]
MODE_COLUMNS = ["slice_id", "slice_prb", "scheduler_code"]
SUM_COLUMNS = ["requested_prbs", "granted_prbs"]
MEAN_COLUMNS = [
    c for c in STATE_COLUMNS if c not in {*MODE_COLUMNS, *SUM_COLUMNS, "grant_ratio"}
]

# --- fixed values: raw trace header -> column name -------------------------------------------
TRACE_HEADER = {
    "Timestamp": "timestamp_ms",
    "num_ues": "num_ues",
    "slice_id": "slice_id",
    "slice_prb": "slice_prb",
    "power_multiplier": "power_multiplier",
    "scheduling_policy": "scheduler_code",
    "dl_mcs": "dl_mcs",
    "dl_buffer [bytes]": "dl_buffer_bytes",
    "tx_brate downlink [Mbps]": "dl_bitrate_mbps",
    "tx_errors downlink (%)": "dl_errors_pct",
    "dl_cqi": "dl_cqi",
    "ul_mcs": "ul_mcs",
    "ul_buffer [bytes]": "ul_buffer_bytes",
    "rx_brate uplink [Mbps]": "ul_bitrate_mbps",
    "rx_errors uplink (%)": "ul_errors_pct",
    "ul_sinr": "ul_sinr",
    "sum_requested_prbs": "requested_prbs",
    "sum_granted_prbs": "granted_prbs",
}
FILE_ID_COLUMNS = ["scenario", "training_config", "experiment", "base_station", "imsi_file"]
CLUSTER_COLUMNS = ["scenario", "training_config", "experiment"]
CELL_COLUMNS = ["scenario", "training_config", "experiment", "base_station"]

# --- fixed values: publication split ---------------------------------------------------------
TRAIN_SCENARIOS = ["rome_static_close", "rome_static_medium"]
UNSEEN_SCENARIOS = ["rome_static_far", "rome_slow_close"]
TRAIN_CONFIGS = list(range(0, 12))
VALIDATION_CONFIGS = [12, 13, 14]
TEST_CONFIGS = [15, 16, 17]
SHIFT_TYPES = {
    "rome_static_far": "rf_distance_shift",
    "rome_slow_close": "mobility_shift",
}

# --- fixed values: context features used by support estimates --------------------------------
CONTEXT_COLUMNS = [
    "num_ues",
    "dl_buffer_bytes",
    "ul_buffer_bytes",
    "dl_cqi",
    "ul_sinr",
    "requested_prbs",
]

# --- fixed values: KPI snapshot --------------------------------------------------------------
KPI_RANGES = {
    "prb_utilization": (0.0, 1.5),
    "active_users": (0.0, 100000.0),
    "downlink_mbps": (0.0, 100000.0),
    "uplink_mbps": (0.0, 100000.0),
    "latency_ms": (0.0, 10000.0),
    "jitter_ms": (0.0, 10000.0),
    "packet_loss_pct": (0.0, 100.0),
    "throughput_demand_mbps": (0.0, 100000.0),
    "energy_load": (0.0, 1.5),
    "handover_failure_pct": (0.0, 100.0),
    "rsrp_dbm": (-160.0, -20.0),
    "sinr_db": (-30.0, 80.0),
}
KPI_COLUMNS = list(KPI_RANGES)

# --- fixed values: feature envelope of the out-of-distribution score -------------------------
OOD_ENVELOPE = {
    "prb_utilization": (0.05, 1.18),
    "active_users": (0.0, 1400.0),
    "downlink_mbps": (0.0, 600.0),
    "uplink_mbps": (0.0, 180.0),
    "latency_ms": (0.5, 260.0),
    "jitter_ms": (0.0, 90.0),
    "packet_loss_pct": (0.0, 15.0),
    "throughput_demand_mbps": (0.0, 500.0),
    "energy_load": (0.05, 1.2),
    "handover_failure_pct": (0.0, 15.0),
    "rsrp_dbm": (-130.0, -55.0),
    "sinr_db": (-10.0, 40.0),
}

# --- fixed values: policy catalogue ----------------------------------------------------------
# name: scheduler, prb share delta, tx power delta, latency, throughput, loss, energy,
#       handover factors, sinr delta
POLICIES = {
    "balanced": ("proportional_fair", 0.0, 0.0, 0.97, 1.02, 0.96, 1.0, 0.98, 0.0),
    "latency_guard": ("deadline_aware", 0.12, 0.5, 0.56, 0.98, 0.66, 1.08, 0.88, 0.8),
    "throughput_boost": ("throughput_aware", 0.10, 0.8, 0.94, 1.24, 0.93, 1.12, 0.98, 1.0),
    "congestion_relief": ("load_aware", -0.14, 0.0, 0.72, 0.92, 0.58, 0.96, 0.90, 0.2),
    "energy_saver": ("energy_aware", -0.08, -2.0, 1.14, 0.90, 1.08, 0.72, 1.02, -1.5),
    "coverage_recovery": ("coverage_aware", 0.06, 2.0, 0.86, 1.10, 0.74, 1.16, 0.78, 3.0),
    "massive_iot_access": ("grant_efficient", 0.04, 0.2, 0.84, 1.04, 0.70, 0.94, 0.94, 0.3),
}
POLICY_FIELDS = [
    "scheduler", "prb_share_delta", "tx_power_db_delta", "latency_factor", "throughput_factor",
    "loss_factor", "energy_factor", "handover_factor", "sinr_delta",
]
POLICY_NAMES = list(POLICIES)

# --- fixed values: slice service targets and default weights ---------------------------------
SERVICE_TARGETS = {"URLLC": (10.0, 0.10), "eMBB": (40.0, 0.80), "mMTC": (110.0, 1.20)}
OBJECTIVES = ["latency", "loss", "throughput", "stability", "energy"]
SLICE_WEIGHTS = {
    "URLLC": (0.43, 0.27, 0.12, 0.08, 0.10),
    "eMBB": (0.18, 0.14, 0.40, 0.10, 0.18),
    "mMTC": (0.14, 0.30, 0.14, 0.22, 0.20),
}

# --- fixed values: intent profiles -----------------------------------------------------------
# name: (latency, loss, throughput, stability, energy weights), risk tolerance, energy budget,
#       constraints (metric, operator, value, hard)
INTENTS = {
    "balanced": ((0.22, 0.20, 0.28, 0.15, 0.15), 0.30, None, []),
    "urllc-strict": (
        (0.43, 0.27, 0.12, 0.10, 0.08), 0.15, None,
        [("latency_ms", "<=", 10.0, True), ("packet_loss_pct", "<=", 0.10, True)],
    ),
    "embb-capacity": ((0.16, 0.12, 0.45, 0.10, 0.17), 0.32, None, []),
    "mmtc-reliability": ((0.10, 0.31, 0.12, 0.25, 0.22), 0.22, None, []),
    "green-ran": (
        (0.12, 0.15, 0.18, 0.15, 0.40), 0.20, 0.82, [("energy_load", "<=", 0.72, False)],
    ),
}
DEFAULT_INTENT = {"URLLC": "urllc-strict", "mMTC": "mmtc-reliability", "eMBB": "embb-capacity"}

# --- fixed values: injected faults -----------------------------------------------------------
FAULTS = [
    "traffic_spike", "cell_outage", "backhaul_degradation", "poor_radio", "handover_storm",
    "packet_loss_burst", "stale_telemetry", "corrupted_kpi", "model_drift",
    "neighbor_interference",
]

# --- fixed values: nested metric aliases (priority order) and defaults -----------------------
METRIC_ALIASES = {
    "downlink_mbps": ["DRB.UEThpDl", "dl_brate", "dl_bitrate", "downlink_mbps"],
    "uplink_mbps": ["DRB.UEThpUl", "ul_brate", "ul_bitrate", "uplink_mbps"],
    "packet_loss_pct": ["DRB.RlcPacketDropRateDl", "rlc_drop_rate", "packet_loss_pct"],
    "rsrp_dbm": ["RSRP", "rsrp", "rsrp_dbm"],
    "sinr_db": ["SINR", "sinr", "sinr_db", "cqi"],
    "prb_utilization": ["prb_utilization", "dl_prb_usage", "dl_prb", "prb"],
    "active_users": ["active_users", "nof_ues", "ue_count"],
    "latency_ms": ["latency_ms", "rlc_latency_ms", "delay_ms"],
    "jitter_ms": ["jitter_ms"],
    "energy_load": ["energy_load", "cpu_load", "ru_power_normalized"],
    "handover_failure_pct": ["handover_failure_pct", "ho_failure_rate"],
    "throughput_demand_mbps": ["throughput_demand_mbps", "demand_mbps"],
}
METRIC_DEFAULTS = {
    "downlink_mbps": 0.0, "uplink_mbps": 0.0, "packet_loss_pct": 0.0, "rsrp_dbm": -95.0,
    "sinr_db": 12.0, "prb_utilization": 0.5, "active_users": 1.0, "latency_ms": 30.0,
    "jitter_ms": 5.0, "energy_load": 0.55, "handover_failure_pct": 0.5,
    "throughput_demand_mbps": 1.0,
}

# --- fixed values: foreign column aliases ----------------------------------------------------
COLUMN_ALIASES = {
    "timestamp": ["timestamp", "time", "datetime", "date"],
    "rsrp_dbm": ["rsrpdbm", "rsrp", "ssrsrp", "signaldbm", "signalstrengthdbm", "signal"],
    "rsrq_db": ["rsrqdb", "rsrq", "ssrsrq"],
    "sinr_db": ["sinrdb", "sinr", "sssinr", "snrdb", "snr"],
    "downlink_mbps": ["throughputdlmbps", "dlthroughputmbps", "downloadmbps",
                      "downloadspeedmbps", "download", "throughputdl"],
    "uplink_mbps": ["throughputulmbps", "ulthroughputmbps", "uploadmbps", "uploadspeedmbps",
                    "upload", "throughputul"],
    "latency_ms": ["latencyms", "latency", "pingms", "ping", "roundtriptimems",
                   "roundtriptime", "rttms", "rtt"],
    "jitter_ms": ["jitterms", "jitter", "stdroundtriptimems", "rttstdms"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon", "lng"],
    "location": ["location", "area", "site", "route"],
    "provider": ["provider", "operator", "network"],
    "device": ["device", "handset", "ue"],
}
MEASURED_FIELDS = ["rsrp_dbm", "sinr_db", "downlink_mbps", "uplink_mbps", "latency_ms",
                   "jitter_ms"]
MEASURED_NUMERIC = ["rsrp_dbm", "rsrq_db", "sinr_db", "downlink_mbps", "uplink_mbps",
                    "latency_ms", "jitter_ms", "latitude", "longitude"]
MEASURED_TEXT = ["timestamp", "location", "provider", "device"]
