"""21 known sites and the summaries of their three sectors."""

COLUMNS = ["site_id", "area_m2", "confidence", "risk_score", "threat_level", "estimated_tonnage", "waste_type", "detection_date"]

SITES = [
    ("RTM-001", 141139.51, 0.685, 51, "High", 42341.85, "construction", "2026-08-28"),
    ("RTM-002", 26507.97, 0.775, 33, "Moderate", 2650.8, "hazardous", "2026-09-23"),
    ("RTM-003", 165519.95, 0.892, 47, "Moderate", 16552.0, "hazardous", "2026-08-31"),
    ("RTM-004", 361757.3, 0.859, 70, "High", 54263.6, "mixed", "2026-09-05"),
    ("RTM-005", 404353.53, 0.691, 63, "High", 121306.06, "construction", "2026-09-23"),
    ("RTM-006", 142846.25, 0.784, 50, "High", 42853.87, "construction", "2026-08-28"),
    ("RTM-007", 378014.92, 0.69, 64, "High", 56702.24, "mixed", "2026-08-29"),
    ("AMZ-001", 88997.24, 0.632, 41, "Moderate", 26699.17, "construction", "2026-09-15"),
    ("AMZ-002", 401701.22, 0.854, 81, "Critical", 120510.37, "construction", "2026-08-26"),
    ("AMZ-003", 294119.31, 0.864, 70, "High", 88235.79, "construction", "2026-09-13"),
    ("AMZ-004", 230076.17, 0.728, 62, "High", 34511.42, "mixed", "2026-08-26"),
    ("AMZ-005", 61693.77, 0.911, 55, "High", 9254.07, "mixed", "2026-09-25"),
    ("AMZ-006", 138690.79, 0.907, 53, "High", 20803.62, "mixed", "2026-09-12"),
    ("CGO-001", 48589.6, 0.696, 32, "Moderate", 14576.88, "construction", "2026-08-29"),
    ("CGO-002", 418188.35, 0.972, 73, "High", 125456.51, "construction", "2026-09-13"),
    ("CGO-003", 428726.42, 0.756, 68, "High", 64308.96, "mixed", "2026-08-27"),
    ("CGO-004", 360765.13, 0.889, 77, "Critical", 54114.77, "mixed", "2026-09-23"),
    ("CGO-005", 233269.21, 0.697, 50, "High", 34990.38, "mixed", "2026-08-31"),
    ("CGO-006", 29276.9, 0.83, 42, "Moderate", 2927.69, "hazardous", "2026-09-16"),
    ("CGO-007", 413221.46, 0.783, 77, "Critical", 123966.44, "construction", "2026-09-15"),
    ("CGO-008", 455146.88, 0.715, 71, "High", 68272.03, "mixed", "2026-08-26"),
]

SECTOR_OF = {"RTM": "sector-7", "AMZ": "sector-12", "CGO": "sector-4"}

# sector: sites, area, tonnage, (Critical, High, Moderate, Low), (mixed, construction, hazardous, electronic), mean confidence, mean risk
SUMMARIES = {
    "sector-7": (7, 1620139.43, 336670.42, (0, 5, 2, 0), (2, 3, 2, 0), 0.768, 54.0),
    "sector-12": (6, 1215278.5, 300014.44, (1, 4, 1, 0), (3, 3, 0, 0), 0.816, 60.3),
    "sector-4": (8, 2387183.95, 488613.66, (2, 4, 2, 0), (4, 3, 1, 0), 0.792, 61.2),
}
