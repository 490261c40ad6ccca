"""A small synthetic export, one folder per person, with the known quirks."""

from __future__ import annotations

import csv
import json
from pathlib import Path


def _json(path: Path, records: list) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(records))


def _csv(path: Path, header: list, rows: list) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as handle:
        writer = csv.writer(handle)
        writer.writerow(header)
        writer.writerows(rows)


def write_tree(root: Path) -> Path:
    a, b = root / "p01", root / "p03"
    day = "2020-02-03"
    minutes = [{"dateTime": f"{day} {h:02d}:{m:02d}:00", "value": "10" if h == 9 else "0"} for h in (9, 10) for m in range(60)]
    minutes += [{"dateTime": f"{day} 09:00:00", "value": "0"}, {"dateTime": f"{day} 11:00:00", "value": "oops"}]
    _json(a / "watch" / "steps.json", minutes)
    _json(a / "watch" / "distance.json", [{"dateTime": f"{day} 09:00:00", "value": "314159"}])
    _json(a / "watch" / "calories.json", [{"dateTime": f"{day} 09:0{i}:00", "value": "1.39"} for i in range(5)])
    _json(a / "watch" / "heart_rate.json", [
        {"dateTime": f"{day} 09:00:00", "value": {"bpm": 60, "confidence": 2}},
        {"dateTime": f"{day} 09:00:00", "value": {"bpm": 62, "confidence": 2}},
        {"dateTime": f"{day} 09:00:05", "value": {"bpm": 250, "confidence": 1}},
        {"dateTime": f"{day} 09:00:10", "value": {"bpm": 70, "confidence": 0}},
        {"dateTime": f"{day} 09:01:00", "value": {"bpm": 64, "confidence": None}}])
    _json(a / "watch" / "resting_heart_rate.json", [
        {"dateTime": "02/02/20 00:00:00", "value": {"date": None, "value": 0.0, "error": 0.0}},
        {"dateTime": "03/02/20 00:00:00", "value": {"date": "02/03/20", "value": 51.5, "error": 6.8}}])
    _json(a / "watch" / "time_in_heart_rate_zones.json", [
        {"dateTime": f"{day} 00:00:00", "value": {"valuesInZones": {"BELOW_DEFAULT_ZONE_1": 84.0, "IN_DEFAULT_ZONE_1": 13.0,
                                                                    "IN_DEFAULT_ZONE_2": 6.0, "IN_DEFAULT_ZONE_3": 3.0}}}])
    stages = {"summary": {s: {"minutes": m} for s, m in (("deep", 41), ("light", 222), ("rem", 97), ("wake", 40))},
              "data": [{"dateTime": f"{day}T00:10:00", "level": "deep", "seconds": 30}]}
    classic = {"summary": {s: {"minutes": m} for s, m in (("asleep", 50), ("restless", 3), ("awake", 2))}}
    night = dict(dateOfSleep=day, startTime="2020-02-02T23:30:00.000", endTime=f"{day}T07:30:00.000", minutesAsleep=360,
                 minutesAwake=40, timeInBed=400, efficiency=90, type="stages", mainSleep=True, levels=stages)
    _json(a / "watch" / "sleep.json", [
        {"logId": 1, **night},
        {"logId": 2, **night, "minutesAsleep": 60, "endTime": f"{day}T08:30:00.000", "type": "classic", "levels": classic},
        {"logId": 3, **night, "mainSleep": False, "startTime": f"{day}T14:00:00.000", "endTime": f"{day}T14:30:00.000", "minutesAsleep": 30}])
    _json(a / "watch" / "exercise.json", [
        {"logId": 1, "activityName": "Run", "startTime": f"{day} 17:00:00", "activeDuration": 1530000, "duration": 1400000},
        {"logId": 2, "activityName": "Walk", "startTime": f"{day} 18:00:00", "duration": 1000}])
    _csv(a / "watch" / "sleep_score.csv", ["timestamp", "sleep_log_entry_id", "overall_score", "composition_score", "revitalization_score",
                                           "duration_score", "deep_sleep_in_minutes", "resting_heart_rate", "restlessness"],
         [[f"{day}T07:30:00Z", 1, 72, 18, 17, 37, 36, 53, 0.5]])
    _csv(a / "forms" / "wellness.csv", ["effective_time_frame", "fatigue", "mood", "readiness", "sleep_duration_h", "sleep_quality", "soreness",
                                        "soreness_area", "stress"],
         [[f"{day}T06:10:00.000Z", 3, 3, 0, 7, 3, 3, "[]", 3], [f"{day}T13:15:00.000Z", 2, 3, 7, 5, 3, 3, "['knee']", 3],
          ["2020-02-04T06:00:00.000Z", 2, 3, 5, 5, 3, 3, "[]", 3]])
    _csv(a / "forms" / "srpe.csv", ["end_date_time", "activity_names", "perceived_exertion", "duration_min"],
         [[f"{day}T19:00:00.000Z", "['individual', 'running']", 7, 30], ["2020-02-04T19:00:00.000Z", "['team', 'soccer']", "", 60]])
    _csv(a / "forms" / "injury.csv", ["effective_time_frame", "injuries"],
         [["2020-02-01T06:00:00.000Z", "{'right_hand': 'minor'}"], [f"{day}T06:41:17.250Z", "{}"], [f"{day}T07:00:00.000Z", "{'left_foot': 'minor'}"],
          [f"{day}T08:00:00.000Z", "{'left_foot': 'major'}"]])
    _csv(a / "forms" / "reporting.csv", ["date", "timestamp", "meals", "weight", "glasses_of_fluid", "alcohol_consumed"],
         [["03/02/2020", "04/02/2020 12:00:00", "Breakfast, Dinner", 100, 7, "No"], ["03/02/2020", "03/02/2020 12:00:00", "Lunch", "", "", "maybe"]])
    _csv(a / "shots" / "photos.csv", ["file", "datetime", "is_food"],
         [["b.jpg", f"{day} 12:00:00", "yes"], ["a.jpg", f"{day} 12:00:10", "YES"], ["c.jpg", f"{day} 19:00:00", "YES"],
          ["d.png", f"{day} 19:00:05", "NO"], ["e.jpg", "unknown", "YES"]])
    # The second person has steps only.
    _json(b / "watch" / "steps.json", [{"dateTime": f"{day} 12:00:00", "value": "7"}])
    _csv(root / "participants.csv", ["Participant ID", "Age", "Height", "Gender", "A or B person", "Max heart rate", "Stride walk", "Stride run"],
         [["p01", 48, 195, "male ", "A", 182, 80.5, 11.3]])
    return root
