"""Fixed values.

Everything here must equal the published behaviour for results to be right;
it is data, not logic, and every value can be overridden by a parameter.
"""

# -- fixed values: distances and scores -------------------------------------
EARTH_RADIUS_KM = 6371.0
KM_WEIGHT = 100.0
STUCK_WEIGHT = 20.0

# -- fixed values: home coordinates (city, latitude, longitude) --------------
HOME_COORDINATES = [
    ("Taipei", 25.0330, 121.5654),
    ("Hsinchu", 24.8138, 120.9675),
]

# -- fixed values: provider comparison ---------------------------------------
SAFE_ERROR_METERS = 20.0
SAFE_RISK_RATE = 0.05
RISKY_ERROR_METERS = 50.0
RISKY_RISK_RATE = 0.20

# -- fixed values: clustering ------------------------------------------------
CLUSTERS = 3
CLUSTER_SEED = 42
DRIVER_FEATURES = ["total_km", "average_speed", "stuck_count"]
STEP_FEATURES = ["step_distance_km", "is_stuck"]

# -- fixed values: labels and their map colours ------------------------------
LABEL_RISK = "Risk: Congested"
LABEL_GOOD = "Good: Efficient"
LABEL_NORMAL = "Normal: Average"
LABEL_COLOURS = {
    "Risk: Congested": "#ff4d4d",
    "Good: Efficient": "#2ecc71",
    "Normal: Average": "#f1c40f",
}
UNKNOWN_COLOUR = "#gray"

# -- fixed values: label patterns --------------------------------------------
RISK_PATTERN = "(?i)Risk|紅色"
RISK_WORD = "Risk"
RED_ALERT_WORD = "紅色警戒"

# -- fixed values: status texts ----------------------------------------------
STOPS_TEXT = "Driver %s is traveling at %.1f km/h with %d stops."
CONGESTION_TEXT = "Driver %s is driving at %.1f km/h with %d congestion events."
REQUEST_TEXT = "Driver %s is driving at %s km/h and got stuck %s times."
SPEED_TEXT = "%.2f km/h"
MARKER_SPEED = "%.1f km/h"
MARKER_STOPS = "%d times"
ADVICE_PENDING = "Analysis pending..."

# -- fixed values: sentiment, risk levels and advice -------------------------
NEGATIVE = "NEGATIVE"
POSITIVE = "POSITIVE"
HIGH_RISK = "High Risk"
SAFE_DRIVER = "Safe"
UNKNOWN_RISK = "Unknown (Model Error)"
INTERVIEW_ADVICE = "🚨 建議立即進行安全面談，可能存在違規或疲勞駕駛。"
OBSERVE_ADVICE = "🟢 表現尚可，建議持續觀察路況影響。"
INTERVIEW_ACTION = "建議安排安全教育面談"
OBSERVE_ACTION = "觀察其塞車情況是否緩解"

# -- fixed values: states of a result and of a request -----------------------
FAILED = "Failed"
PENDING = "Pending"
SUCCESS = "Success"
FAILURE = "Failure"
