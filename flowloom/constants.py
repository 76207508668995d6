"""Values fixed by the formats and lookups this engine has to agree with.

Everything here is data, not logic: names, codes and limits.
"""

# Domain suffix -> service name; the first matching entry wins.
SERVICE_SUFFIXES = {
    "youtube.com": "YouTube",
    "googlevideo.com": "YouTube",
    "ytimg.com": "YouTube",
    "youtu.be": "YouTube",
    "yt3.ggpht.com": "YouTube",
    "instagram.com": "Instagram",
    "cdninstagram.com": "Instagram",
    "facebook.com": "Facebook",
    "fbcdn.net": "Facebook/IG",
    "fb.com": "Facebook",
    "meta.com": "Meta",
    "whatsapp.com": "WhatsApp",
    "whatsapp.net": "WhatsApp",
    "gmail.com": "Gmail",
    "google.com": "Google",
    "googleapis.com": "Google",
    "gstatic.com": "Google",
    "1e100.net": "Google CDN",
    "googleusercontent.com": "Google",
    "google-analytics.com": "Google Analytics",
    "microsoft.com": "Microsoft",
    "windows.com": "Windows Update",
    "live.com": "Microsoft",
    "office.com": "Microsoft Office",
    "outlook.com": "Outlook",
    "teams.microsoft.com": "MS Teams",
    "netflix.com": "Netflix",
    "nflxvideo.net": "Netflix",
    "nflxso.net": "Netflix",
    "hotstar.com": "Hotstar",
    "spotify.com": "Spotify",
    "scdn.co": "Spotify",
    "prime": "Amazon Prime",
    "primevideo.com": "Amazon Prime",
    "twitter.com": "Twitter/X",
    "x.com": "Twitter/X",
    "twimg.com": "Twitter/X",
    "tiktok.com": "TikTok",
    "tiktokcdn.com": "TikTok",
    "snapchat.com": "Snapchat",
    "snap.com": "Snapchat",
    "linkedin.com": "LinkedIn",
    "telegram.org": "Telegram",
    "akamaihd.net": "Akamai CDN",
    "akamai.net": "Akamai CDN",
    "cloudfront.net": "AWS CloudFront",
    "amazonaws.com": "AWS",
    "cloudflare.com": "Cloudflare",
    "fastly.net": "Fastly CDN",
    "apple.com": "Apple",
    "icloud.com": "iCloud",
    "mzstatic.com": "App Store",
    "play.google.com": "Play Store",
    "roblox.com": "Roblox",
    "epicgames.com": "Epic Games",
    "steampowered.com": "Steam",
}

# First three MAC octets -> vendor.
OUI_VENDORS = {
    "00:03:93": "Apple", "00:0a:27": "Apple", "04:26:65": "Apple",
    "04:db:56": "Apple", "0c:74:c2": "Apple", "10:40:f3": "Apple",
    "14:5a:05": "Apple", "18:81:0e": "Apple", "1c:36:bb": "Apple",
    "20:78:f0": "Apple", "24:a2:e1": "Apple", "28:cf:e9": "Apple",
    "34:08:bc": "Apple", "3c:07:54": "Apple", "40:30:04": "Apple",
    "44:4c:0c": "Apple", "48:43:7c": "Apple", "4c:57:ca": "Apple",
    "54:26:96": "Apple", "58:b0:35": "Apple", "5c:f7:e6": "Apple",
    "60:03:08": "Apple", "64:20:0c": "Apple", "68:64:4b": "Apple",
    "6c:40:08": "Apple", "70:48:0f": "Apple", "74:1b:b2": "Apple",
    "74:e1:b6": "Apple", "78:31:c1": "Apple", "7c:6d:62": "Apple",
    "8c:7b:9d": "Apple", "90:27:e4": "Apple", "94:e9:6a": "Apple",
    "98:01:a7": "Apple", "9c:f4:8e": "Apple", "a0:99:9b": "Apple",
    "a4:c3:61": "Apple", "ac:0d:1b": "Apple", "b4:8b:19": "Apple",
    "b8:ff:61": "Apple", "bc:52:b7": "Apple", "c0:63:94": "Apple",
    "c8:2a:14": "Apple", "cc:08:8d": "Apple", "d0:03:4b": "Apple",
    "d4:f4:6f": "Apple", "dc:2b:2a": "Apple", "e0:ac:cb": "Apple",
    "e4:25:e7": "Apple", "e8:8d:28": "Apple", "f0:18:98": "Apple",
    "f4:f1:5a": "Apple", "f8:27:93": "Apple", "fc:25:3f": "Apple",
    "00:07:ab": "Samsung", "04:18:d6": "Samsung", "08:08:c2": "Samsung",
    "14:49:e0": "Samsung", "18:22:7e": "Samsung", "20:13:e0": "Samsung",
    "24:4b:81": "Samsung", "28:27:bf": "Samsung", "38:1f:8d": "Samsung",
    "40:4e:36": "Samsung", "44:a7:cf": "Samsung", "50:01:bb": "Samsung",
    "54:40:ad": "Samsung", "60:a1:0a": "Samsung", "68:eb:ae": "Samsung",
    "70:f9:27": "Samsung", "78:25:ad": "Samsung", "84:a4:66": "Samsung",
    "88:36:6c": "Samsung", "90:18:7c": "Samsung", "98:52:3d": "Samsung",
    "a0:0b:ba": "Samsung", "a4:eb:d3": "Samsung", "b4:3a:28": "Samsung",
    "b8:5e:7b": "Samsung", "d0:22:be": "Samsung", "d4:88:90": "Samsung",
    "dc:71:96": "Samsung", "04:cf:8c": "Xiaomi", "0c:1d:af": "Xiaomi",
    "20:82:c0": "Xiaomi", "28:6c:07": "Xiaomi", "34:80:b3": "Xiaomi",
    "40:31:3c": "Xiaomi", "4c:63:71": "Xiaomi", "58:44:98": "Xiaomi",
    "64:09:80": "Xiaomi", "74:51:ba": "Xiaomi", "8c:be:be": "Xiaomi",
    "94:fb:a7": "Xiaomi", "a0:86:c6": "Xiaomi", "b0:e2:35": "Xiaomi",
    "c0:ee:fb": "Xiaomi", "e4:46:da": "Xiaomi", "f0:b4:29": "Xiaomi",
    "f4:8b:32": "Xiaomi", "04:d3:b5": "OnePlus", "20:0f:23": "OnePlus",
    "3c:28:6d": "OnePlus", "4c:8b:30": "OnePlus", "64:cc:2e": "OnePlus",
    "8c:8d:28": "OnePlus", "a8:9c:ed": "OnePlus", "1c:77:f6": "OPPO",
    "28:ba:b5": "OPPO", "44:74:6c": "OPPO", "4c:1a:3d": "Realme",
    "54:f6:02": "Realme", "68:3e:26": "Realme", "04:03:d6": "Vivo",
    "5c:0a:5b": "Vivo", "cc:2d:e0": "Vivo", "30:fd:38": "Pixel",
    "3c:5a:b4": "Pixel", "54:60:09": "Pixel", "94:eb:2c": "Pixel",
    "00:18:82": "Huawei", "04:f9:38": "Huawei", "18:a1:71": "Huawei",
    "28:31:52": "Huawei", "34:6b:d3": "Huawei", "40:4d:8e": "Huawei",
    "48:00:31": "Huawei", "54:89:98": "Huawei", "70:72:3c": "Huawei",
    "8c:34:fd": "Huawei", "ac:e2:15": "Huawei", "c8:51:95": "Huawei",
    "00:16:6b": "Motorola", "2c:d0:5a": "Motorola", "40:78:6a": "Motorola",
    "88:79:7e": "Motorola", "d8:0d:17": "TP-Link", "50:d4:f7": "TP-Link",
    "14:cc:20": "TP-Link", "10:bf:48": "D-Link", "1c:7e:e5": "D-Link",
    "00:50:f2": "Microsoft", "28:18:78": "Microsoft",
}

# Column names of the 2017 flow files -> names of the 2018 flow files.
CIC_2017_TO_2018 = {
    "Destination Port": "Dst Port",
    "Total Fwd Packets": "Tot Fwd Pkts",
    "Total Backward Packets": "Tot Bwd Pkts",
    "Total Length of Fwd Packets": "TotLen Fwd Pkts",
    "Total Length of Bwd Packets": "TotLen Bwd Pkts",
    "Fwd Packet Length Max": "Fwd Pkt Len Max",
    "Fwd Packet Length Min": "Fwd Pkt Len Min",
    "Fwd Packet Length Mean": "Fwd Pkt Len Mean",
    "Fwd Packet Length Std": "Fwd Pkt Len Std",
    "Bwd Packet Length Max": "Bwd Pkt Len Max",
    "Bwd Packet Length Min": "Bwd Pkt Len Min",
    "Bwd Packet Length Mean": "Bwd Pkt Len Mean",
    "Bwd Packet Length Std": "Bwd Pkt Len Std",
    "Flow Bytes/s": "Flow Byts/s",
    "Flow Packets/s": "Flow Pkts/s",
    "Fwd IAT Total": "Fwd IAT Tot",
    "Bwd IAT Total": "Bwd IAT Tot",
    "Fwd Header Length": "Fwd Header Len",
    "Bwd Header Length": "Bwd Header Len",
    "Fwd Packets/s": "Fwd Pkts/s",
    "Bwd Packets/s": "Bwd Pkts/s",
    "Min Packet Length": "Pkt Len Min",
    "Max Packet Length": "Pkt Len Max",
    "Packet Length Mean": "Pkt Len Mean",
    "Packet Length Std": "Pkt Len Std",
    "Packet Length Variance": "Pkt Len Var",
    "FIN Flag Count": "FIN Flag Cnt",
    "SYN Flag Count": "SYN Flag Cnt",
    "RST Flag Count": "RST Flag Cnt",
    "PSH Flag Count": "PSH Flag Cnt",
    "ACK Flag Count": "ACK Flag Cnt",
    "URG Flag Count": "URG Flag Cnt",
    "ECE Flag Count": "ECE Flag Cnt",
    "Average Packet Size": "Pkt Size Avg",
    "Avg Fwd Segment Size": "Fwd Seg Size Avg",
    "Avg Bwd Segment Size": "Bwd Seg Size Avg",
    "Fwd Header Length.1": "Fwd Header Len",
    "Fwd Avg Bytes/Bulk": "Fwd Byts/b Avg",
    "Fwd Avg Packets/Bulk": "Fwd Pkts/b Avg",
    "Fwd Avg Bulk Rate": "Fwd Blk Rate Avg",
    "Bwd Avg Bytes/Bulk": "Bwd Byts/b Avg",
    "Bwd Avg Packets/Bulk": "Bwd Pkts/b Avg",
    "Bwd Avg Bulk Rate": "Bwd Blk Rate Avg",
    "Subflow Fwd Packets": "Subflow Fwd Pkts",
    "Subflow Fwd Bytes": "Subflow Fwd Byts",
    "Subflow Bwd Packets": "Subflow Bwd Pkts",
    "Subflow Bwd Bytes": "Subflow Bwd Byts",
    "Init_Win_bytes_forward": "Init Fwd Win Byts",
    "Init_Win_bytes_backward": "Init Bwd Win Byts",
    "act_data_pkt_fwd": "Fwd Act Data Pkts",
    "min_seg_size_forward": "Fwd Seg Size Min",
}

# Feature column -> name in the 2018 flow files, in output order.
FLOW_FEATURES = {
    "dst_port": "Dst Port",
    "protocol": "Protocol",
    "flow_duration": "Flow Duration",
    "tot_fwd_pkts": "Tot Fwd Pkts",
    "tot_bwd_pkts": "Tot Bwd Pkts",
    "totlen_fwd_pkts": "TotLen Fwd Pkts",
    "totlen_bwd_pkts": "TotLen Bwd Pkts",
    "fwd_header_len": "Fwd Header Len",
    "bwd_header_len": "Bwd Header Len",
    "down_up_ratio": "Down/Up Ratio",
    "fwd_psh_flags": "Fwd PSH Flags",
    "bwd_psh_flags": "Bwd PSH Flags",
    "fwd_urg_flags": "Fwd URG Flags",
    "bwd_urg_flags": "Bwd URG Flags",
    "pkt_size_avg": "Pkt Size Avg",
    "fwd_byts_per_bulk_avg": "Fwd Byts/b Avg",
    "fwd_pkts_per_bulk_avg": "Fwd Pkts/b Avg",
    "fwd_blk_rate_avg": "Fwd Blk Rate Avg",
    "bwd_byts_per_bulk_avg": "Bwd Byts/b Avg",
    "bwd_pkts_per_bulk_avg": "Bwd Pkts/b Avg",
    "bwd_blk_rate_avg": "Bwd Blk Rate Avg",
    "fwd_seg_size_avg": "Fwd Seg Size Avg",
    "bwd_seg_size_avg": "Bwd Seg Size Avg",
    "fwd_seg_size_min": "Fwd Seg Size Min",
    "init_fwd_win_byts": "Init Fwd Win Byts",
    "init_bwd_win_byts": "Init Bwd Win Byts",
    "fwd_act_data_pkts": "Fwd Act Data Pkts",
    "fwd_pkt_len_max": "Fwd Pkt Len Max",
    "fwd_pkt_len_min": "Fwd Pkt Len Min",
    "fwd_pkt_len_mean": "Fwd Pkt Len Mean",
    "fwd_pkt_len_std": "Fwd Pkt Len Std",
    "bwd_pkt_len_max": "Bwd Pkt Len Max",
    "bwd_pkt_len_min": "Bwd Pkt Len Min",
    "bwd_pkt_len_mean": "Bwd Pkt Len Mean",
    "bwd_pkt_len_std": "Bwd Pkt Len Std",
    "pkt_len_min": "Pkt Len Min",
    "pkt_len_max": "Pkt Len Max",
    "pkt_len_mean": "Pkt Len Mean",
    "pkt_len_std": "Pkt Len Std",
    "pkt_len_var": "Pkt Len Var",
    "flow_byts_per_s": "Flow Byts/s",
    "flow_pkts_per_s": "Flow Pkts/s",
    "fwd_pkts_per_s": "Fwd Pkts/s",
    "bwd_pkts_per_s": "Bwd Pkts/s",
    "flow_iat_mean": "Flow IAT Mean",
    "flow_iat_std": "Flow IAT Std",
    "flow_iat_max": "Flow IAT Max",
    "flow_iat_min": "Flow IAT Min",
    "fwd_iat_tot": "Fwd IAT Tot",
    "fwd_iat_mean": "Fwd IAT Mean",
    "fwd_iat_std": "Fwd IAT Std",
    "fwd_iat_max": "Fwd IAT Max",
    "fwd_iat_min": "Fwd IAT Min",
    "bwd_iat_tot": "Bwd IAT Tot",
    "bwd_iat_mean": "Bwd IAT Mean",
    "bwd_iat_std": "Bwd IAT Std",
    "bwd_iat_max": "Bwd IAT Max",
    "bwd_iat_min": "Bwd IAT Min",
    "fin_flag_cnt": "FIN Flag Cnt",
    "syn_flag_cnt": "SYN Flag Cnt",
    "rst_flag_cnt": "RST Flag Cnt",
    "psh_flag_cnt": "PSH Flag Cnt",
    "ack_flag_cnt": "ACK Flag Cnt",
    "urg_flag_cnt": "URG Flag Cnt",
    "cwe_flag_count": "CWE Flag Count",
    "ece_flag_cnt": "ECE Flag Cnt",
    "subflow_fwd_pkts": "Subflow Fwd Pkts",
    "subflow_fwd_byts": "Subflow Fwd Byts",
    "subflow_bwd_pkts": "Subflow Bwd Pkts",
    "subflow_bwd_byts": "Subflow Bwd Byts",
    "active_mean": "Active Mean",
    "active_std": "Active Std",
    "active_max": "Active Max",
    "active_min": "Active Min",
    "idle_mean": "Idle Mean",
    "idle_std": "Idle Std",
    "idle_max": "Idle Max",
    "idle_min": "Idle Min",
}

# IP protocol number -> name.
PROTO_NAMES = {
    1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP",
    41: "IPv6", 47: "GRE", 50: "ESP", 51: "AH",
    58: "ICMPv6", 89: "OSPF", 132: "SCTP",
}

# ICMP type -> name.
ICMP_TYPES = {
    0: "Echo Reply", 3: "Dest Unreachable", 4: "Source Quench",
    5: "Redirect", 8: "Echo Request", 9: "Router Advert",
    10: "Router Solicit", 11: "Time Exceeded", 12: "Param Problem",
    13: "Timestamp", 14: "Timestamp Reply", 30: "Traceroute",
}

# Address prefixes of virtual adapters that are not tracked.
VIRTUAL_PREFIXES = (
    "192.168.40.", "192.168.80.", "192.168.56.",
    "192.168.99.", "10.0.2.", "172.16.0.",
)

# Columns that identify a flow and are not features.
IDENTIFIER_COLUMNS = ("Flow ID", "Src IP", "Dst IP", "Timestamp", "Src Port")

# Thresholds of the sweep, in report order.
SWEEP_THRESHOLDS = (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)

# Limits of sampling, balancing and clipping.
SAMPLE_PER_FILE = 80_000
BENIGN_PER_ATTACK = 10
TEST_SHARE = 0.2
SEED = 42
CLIP_LIMIT = 1e10

# Text shown for an unknown MAC, size of the name caches.
UNKNOWN_MAC = "??:??:??:??:??:??"
NAME_CACHE_SIZE = 2000

# The file evaluation looks for first.
PREFERRED_CSV = "Thursday-22-02-2018.csv"

# Private addresses as patterns, "#" standing for one decimal octet. 192.0.0.9 and
# 192.0.0.10 are reachable exceptions. IPv6 is taken in compressed form: unspecified, loopback,
# local translation, discard only, protocol assignments (with their reachable exceptions),
# documentation, 6to4, unique local, link-local.
PRIVATE_PATTERNS = (
    r"(0|10|127)\.#\.#\.#",
    r"169\.254\.#\.#",
    r"172\.(1[6-9]|2[0-9]|3[01])\.#\.#",
    r"192\.0\.0\.(?!9$|10$)#",
    r"192\.0\.2\.#",
    r"192\.168\.#\.#",
    r"198\.1[89]\.#\.#",
    r"198\.51\.100\.#",
    r"203\.0\.113\.#",
    r"(24[0-9]|25[0-5])\.#\.#\.#",
    r"::1?",
    r"64:ff9b:1:.*",
    r"100::([0-9a-f]{1,4}(:[0-9a-f]{1,4}){0,3})?",
    r"2001:(?!1::[12]$|3:|4:112:|[23][0-9a-f]:)(:|0{0,2}[0-9a-f]{1,2}:|0?1[0-9a-f]{2}:).*",
    r"2001:0?db8:.*",
    r"2002:.*",
    r"f[cd][0-9a-f]{2}:.*",
    r"fe[89ab][0-9a-f]:.*",
)
