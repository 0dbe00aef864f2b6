"""Schemas of events, records and documents."""

from __future__ import annotations

TRACK = "struct<spotify_id:string,isrc:string,mbid:string,name:string,artist:string,album:string>"
CONTEXT = "struct<ms_played:bigint,skipped:boolean,incognito:boolean,conn_country:string>"
EVENT = f"track {TRACK}, played_at timestamp, source string, context {CONTEXT}"
FEATURES = "struct<bpm:double,energy:double,valence:double,danceability:double,acousticness:double,instrumentalness:double,source:string>"
TAG = "struct<tag:string,weight:double,source:string>"
RECORD = f"track_id string, spotify_id string, isrc string, mbid string, name string, artist string, audio_features {FEATURES}, tags array<{TAG}>, fetched_at timestamp"
CANDIDATE = "candidate_id string, category string, label string, cluster_size bigint, cluster_share double, evidence_count bigint, coverage double, confidence double, stability_score double"
