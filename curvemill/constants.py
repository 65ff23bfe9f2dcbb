"""Fixed values. Everything here must keep these exact numbers for results to be right."""

# class taxonomy, index = position
CLASSES = ["transit", "eclipse", "blend", "variable", "noise"]
# the classes a catalogue disposition can express
CATALOGUE_CLASSES = ["transit", "eclipse", "blend", "variable"]
# labels that assert a geometric event and can be contradicted by a dip fit
GEOMETRIC_CLASSES = ["transit", "eclipse", "blend"]

# feature order of the vetting vector
FEATURE_NAMES = [
    "log_depth", "log_duration_hr", "log_period", "duration_phase_frac",
    "sde", "log_snr", "n_transits",
    "odd_even_sigma", "odd_even_frac",
    "secondary_sigma", "secondary_depth_ratio",
    "sec_sigma_2p", "sec_ratio_2p", "sec_ratio_2p_dev", "odd_even_sigma_2p",
    "trap_t23_t14", "trap_depth_ratio", "shape_resid_ratio",
    "log_rho_implied", "depth_consistency", "ls_power_ratio",
    "oot_skew", "log_oot_var_to_depth",
]

# instrument quality bits that reject a sample
QUALITY_MASK = 17087

# search grid
MIN_PERIOD = 0.5
MAX_PERIOD = 13.0
DURATIONS = [0.03, 0.05, 0.08, 0.12, 0.18, 0.25]
OVERSAMPLE = 5
SDE_THRESHOLD = 7.0
SEARCH_BIN_MINUTES = 10.0

# cleaning
DETREND_WINDOW_DAYS = 0.5
CLIP_UPPER = 4.0
MAD_TO_SIGMA = 1.4826
MIN_POINTS_INGEST = 500
MIN_POINTS_CLEAN = 100

# physics (cgs)
G_CGS = 6.67430e-8
DAY_SECONDS = 86400.0

# fit
CHI2_RELIABLE_MAX = 3.0

# Lomb-Scargle band, cycles per day
LS_FREQ_MIN = 0.05
LS_FREQ_MAX = 5.0
LS_FREQ_COUNT = 4000

# brightness strata: name, low (inclusive), high (exclusive)
BRIGHTNESS_BINS = {
    "kepler": [("bright", 9.0, 12.5), ("medium", 12.5, 13.8), ("faint", 13.8, 15.0)],
    "tess": [("bright", 6.0, 9.5), ("medium", 9.5, 11.5), ("faint", 11.5, 13.5)],
}

# two-sided 95 % normal quantile
Z95 = 1.959963984540054

# archive observation filter
EXPOSURE_RANGE = (100, 140)
