"""Countries and the zone of most of their people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ISO country codes and IANA zone names.
COUNTRY_ZONES = {
    "KZ": "Asia/Almaty",
    "KG": "Asia/Bishkek",
    "UZ": "Asia/Tashkent",
    "TJ": "Asia/Dushanbe",
    "TM": "Asia/Ashgabat",
    "AZ": "Asia/Baku",
    "GE": "Asia/Tbilisi",
    "AM": "Asia/Yerevan",
    "GB": "Europe/London",
    "IE": "Europe/Dublin",
    "PT": "Europe/Lisbon",
    "ES": "Europe/Madrid",
    "FR": "Europe/Paris",
    "BE": "Europe/Brussels",
    "NL": "Europe/Amsterdam",
    "LU": "Europe/Luxembourg",
    "DE": "Europe/Berlin",
    "CH": "Europe/Zurich",
    "AT": "Europe/Vienna",
    "IT": "Europe/Rome",
    "MT": "Europe/Malta",
    "DK": "Europe/Copenhagen",
    "NO": "Europe/Oslo",
    "SE": "Europe/Stockholm",
    "FI": "Europe/Helsinki",
    "IS": "Atlantic/Reykjavik",
    "PL": "Europe/Warsaw",
    "CZ": "Europe/Prague",
    "SK": "Europe/Bratislava",
    "HU": "Europe/Budapest",
    "SI": "Europe/Ljubljana",
    "HR": "Europe/Zagreb",
    "BA": "Europe/Sarajevo",
    "RS": "Europe/Belgrade",
    "ME": "Europe/Podgorica",
    "MK": "Europe/Skopje",
    "AL": "Europe/Tirane",
    "GR": "Europe/Athens",
    "BG": "Europe/Sofia",
    "RO": "Europe/Bucharest",
    "MD": "Europe/Chisinau",
    "UA": "Europe/Kyiv",
    "BY": "Europe/Minsk",
    "LT": "Europe/Vilnius",
    "LV": "Europe/Riga",
    "EE": "Europe/Tallinn",
    "RU": "Europe/Moscow",
    "TR": "Europe/Istanbul",
    "CY": "Asia/Nicosia",
    "IL": "Asia/Jerusalem",
    "AE": "Asia/Dubai",
    "SA": "Asia/Riyadh",
    "QA": "Asia/Qatar",
    "KW": "Asia/Kuwait",
    "IR": "Asia/Tehran",
    "IQ": "Asia/Baghdad",
    "JO": "Asia/Amman",
    "LB": "Asia/Beirut",
    "IN": "Asia/Kolkata",
    "PK": "Asia/Karachi",
    "BD": "Asia/Dhaka",
    "LK": "Asia/Colombo",
    "NP": "Asia/Kathmandu",
    "TH": "Asia/Bangkok",
    "VN": "Asia/Ho_Chi_Minh",
    "MY": "Asia/Kuala_Lumpur",
    "SG": "Asia/Singapore",
    "ID": "Asia/Jakarta",
    "PH": "Asia/Manila",
    "HK": "Asia/Hong_Kong",
    "TW": "Asia/Taipei",
    "CN": "Asia/Shanghai",
    "JP": "Asia/Tokyo",
    "KR": "Asia/Seoul",
    "AU": "Australia/Sydney",
    "NZ": "Pacific/Auckland",
    "EG": "Africa/Cairo",
    "MA": "Africa/Casablanca",
    "DZ": "Africa/Algiers",
    "TN": "Africa/Tunis",
    "NG": "Africa/Lagos",
    "GH": "Africa/Accra",
    "KE": "Africa/Nairobi",
    "ZA": "Africa/Johannesburg",
    "US": "America/New_York",
    "CA": "America/Toronto",
    "MX": "America/Mexico_City",
    "GT": "America/Guatemala",
    "CO": "America/Bogota",
    "PE": "America/Lima",
    "EC": "America/Guayaquil",
    "VE": "America/Caracas",
    "BR": "America/Sao_Paulo",
    "AR": "America/Argentina/Buenos_Aires",
    "CL": "America/Santiago",
    "UY": "America/Montevideo",
    "PY": "America/Asuncion",
    "BO": "America/La_Paz",
    "CR": "America/Costa_Rica",
    "PA": "America/Panama",
    "DO": "America/Santo_Domingo",
    "PR": "America/Puerto_Rico",
}


def country_zones(spark: SparkSession) -> DataFrame:
    """country, zone; small enough to broadcast."""
    return spark.createDataFrame(list(COUNTRY_ZONES.items()), "country string, zone string")
