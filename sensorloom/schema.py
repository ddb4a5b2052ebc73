"""Names shared across operators."""

SESSION_KEYS = ("patient_id", "condition")
WINDOW_KEYS = (*SESSION_KEYS, "window_index")
TARGET = "target_cognitive_load"

# Stream names, electrode channels, bands and feature names, in feature order.
STREAMS = ("eeg", "bvp", "eda", "temperature")
BANDS = ("delta", "theta", "alpha", "beta", "gamma")
ELECTRODES = ("TP9", "AF7", "AF8", "TP10")
WEARABLE_FEATURES = (
    "wearable_pulse_rate_bpm",
    "wearable_pulse_interval_rmssd_ms",
    "wearable_bvp_variability",
    "wearable_eda_mean",
    "wearable_eda_variability",
    "wearable_eda_slope",
    "wearable_temperature_mean",
    "wearable_temperature_variability",
    "wearable_temperature_slope",
)
BAND_CHANNELS = {
    "delta": ("Delta_TP9", "Delta_AF7", "Delta_AF8", "Delta_TP10"),
    "theta": ("Theta_TP9", "Theta_AF7", "Theta_AF8", "Theta_TP10"),
    "alpha": ("Alpha_TP9", "Alpha_AF7", "Alpha_AF8", "Alpha_TP10"),
    "beta": ("Beta_TP9", "Beta_AF7", "Beta_AF8", "Beta_TP10"),
    "gamma": ("Gamma_TP9", "Gamma_AF7", "Gamma_AF8", "Gamma_TP10"),
}
EEG_FEATURES = (
    "eeg_delta_mean",
    "eeg_theta_mean",
    "eeg_alpha_mean",
    "eeg_beta_mean",
    "eeg_gamma_mean",
    "eeg_delta_variability",
    "eeg_theta_variability",
    "eeg_alpha_variability",
    "eeg_beta_variability",
    "eeg_gamma_variability",
    "eeg_theta_alpha_ratio",
    "eeg_beta_alpha_ratio",
)
# End of fixed values.

EEG_CHANNELS = tuple(channel for channels in BAND_CHANNELS.values() for channel in channels)
