"""Seeded random check-ins with the awkward cases the operators must survive."""

import random


def random_rows(seed, n=400, users=6, pois=7, nulls=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = str(rng.randrange(users))
        hour = rng.randrange(60)
        name = rng.randrange(9)
        stamp = f"2024-01-{1 + hour // 24:02d} {hour % 24:02d}:{rng.randrange(60):02d}:{i % 60:02d}"
        row = {
            "user_id": user,
            "trajectory_id": f"{user}_{rng.randrange(3)}",
            "POI_id": f"p{rng.randrange(pois)}",
            "POI_catname": f"n{name}",
            "POI_category": f"t{name % 3}",
            "POI_catid_code": name,
            "latitude": 40.7 + rng.randrange(10) * 0.004,
            "longitude": -74.0 + rng.randrange(10) * 0.004,
            "local_time": stamp,
            "UTC_time": stamp.replace(" ", "T"),
            "day_of_week": rng.randrange(7),
            "norm_in_day_time": rng.random(),
        }
        if nulls and rng.random() < 0.03:
            row["user_id"] = None
        if nulls and rng.random() < 0.03:
            row["trajectory_id"] = None
        rows.append(row)
    # A trajectory of one row.
    rows.append({**rows[0], "user_id": "0", "trajectory_id": "0_99", "POI_id": "p0"})
    return rows
