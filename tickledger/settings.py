"""Tunables of the jobs, one plain dictionary per stage (fixed values).

Distances are in game units, times in seconds, probabilities in [0, 1].
"""

from __future__ import annotations

SAMPLING = {
    "sample_hz": 2.0,
    "boundary_offset_ticks": 1,
    "max_utility_tokens": 16,
    "heard_window_s": 2.0,
    "heard_radius": 1500.0,
}

CLOCK = {"round_time_s": 115.0, "bomb_timer_s": 40.0}

ACTIONS = {
    "simultaneity_ticks": 2,
    "damage_gap_s": 2.0,
    "movement_min_units": 32.0,
    "rotation_min_units": 600.0,
    "rotation_dwell_s": 2.0,
    "hold_min_s": 5.0,
    "hold_max_speed": 20.0,
    "facing_units": 500.0,
    "save_min_units": 800.0,
    "save_window_s": 5.0,
    "late_round_s": 20.0,
    "peek_lookback_s": 0.5,
    "trade_window_s": 5.0,
    "trade_max_units": 1200.0,
    "enabler_recent_s": 3.0,
    "give_window_s": 5.0,
    "match_tol_s": 1.0,
    "pop_delay_s": 2.0,
    "displace_s": 2.0,
}

# exclusive upper bounds of the equipment bands; above the last one the band is "full"
BUY_BANDS = [("pistol", 1000.0), ("eco", 2000.0), ("half", 3500.0), ("force", 4500.0)]
BAND_ORDER = ["pistol", "eco", "half", "force", "full"]

NOMINAL_DURATION_S = {"smoke": 18.0, "fire": 7.0, "decoy": 15.0}
SMOKE_RADIUS = 144.0
FIRE_Z_TOL = 64.0
EYE_STAND = 64.0
EYE_DUCK = 46.0

LABELS = {"hazard_s": 5.0, "plant_s": 15.0, "defuse_s": 15.0, "engagement_cap_s": 30.0}

CALIBRATION = {
    "n_bins": 20,
    "bin_tol": 0.03,
    "min_bin_n": 200,
    "min_group_n": 200,
    "min_improve": 0.002,
    "martingale_horizons_s": [1.0, 5.0, 10.0],
    "martingale_min_n": 500,
    "martingale_tol": 0.01,
    "ece_target": 0.02,
    "logloss_margin": 0.01,
    "hazard_auc_floor": 0.75,
    "patch_ece_max": 0.03,
}

GATE = {
    "unkill_toward_rate": 0.98,
    "unkill_median_abs": 0.03,
    "smoke_floor": -0.01,
    "smoke_floor_rate": 0.95,
    "smoke_max_abs": 0.25,
    "smoke_max_abs_rate": 0.99,
    "unflash_floor": -0.005,
    "unflash_rate": 0.95,
    "unplant_down_rate": 0.95,
    "freeze_max_abs": 0.15,
    "freeze_max_abs_rate": 0.99,
    "freeze_mean_abs": 0.005,
    "ood_k": 10,
    "ood_percentile": 99.0,
    "ood_max_rate": 0.05,
    "n_worst": 20,
}

ATTRIBUTION = {
    "exact_max": 6,
    "samples": 200,
    "drift_threshold": 0.02,
    "enabler_mode": "hazard",
    "enabler_total_cap": 0.5,
    "trade_band": (0.05, 0.40),
    "other_band": (0.0, 0.6),
    "min_hazard": 0.02,
    "fixed_shares": {
        "flash": 0.20,
        "smoke_cover": 0.10,
        "trade_setup": 0.20,
        "he_damage": 0.10,
        "fire_pressure": 0.10,
    },
    "tol_exact": 1e-9,
    "tol_sampled": 1e-6,
}

VALUE = {"k_neighbours": 200, "n_min_regret": 30, "delta_d": 0.01, "delta_x": 0.02, "panel_top": 20}

QA = {"max_speed": 320.0, "max_health": 100.0, "max_alive": 5, "n_examples": 5, "n_hist": 10}

TARGETS = {
    "first_month": "2023-10",
    "pro": {"total": 3000, "per_map": 200, "per_month": 50},
    "faceit_10": {"total": 50000, "per_map": 3000, "per_month": None},
}

CEILINGS = {"gpu": 120.0, "cpu": 300.0}
USAGE_RESIDUAL_MAX = 1e-3
