"""Paragraph boxes (x, y, width, height) of scanned pages and the blocks a reader sees in them."""

PAGES = [
    ('vertical', 1682, 2435, [(202, 55, 429, 79), (251, 336, 1100, 114), (253, 511, 234, 27), (187, 721, 580, 64), (156, 1194, 272, 844), (884, 578, 531, 172), (779, 917, 441, 61), (477, 1039, 506, 649), (476, 1728, 505, 509), (1029, 1068, 497, 197), (1028, 1314, 504, 881), (1057, 2211, 474, 26), (232, 2326, 48, 28), (366, 2323, 293, 35)], [(137, 1171, 310, 882), (458, 1030, 541, 1230), (758, 901, 483, 103), (995, 1051, 567, 1206), (245, 319, 1119, 140), (873, 567, 548, 206)]),
    ('vertical', 1685, 2441, [(156, 186, 506, 607), (157, 849, 508, 626), (337, 1477, 12, 9), (411, 1477, 80, 11), (162, 1488, 497, 240), (167, 1763, 322, 49), (164, 1826, 503, 71), (163, 1936, 500, 258), (710, 195, 323, 39), (1033, 49, 492, 88), (709, 252, 502, 496), (710, 790, 497, 255), (711, 1087, 496, 298), (713, 1428, 498, 592), (757, 2067, 177, 35), (717, 2121, 494, 112), (1261, 356, 268, 200), (1263, 1006, 268, 226), (1267, 1625, 158, 22), (1265, 1654, 269, 52), (1031, 2317, 293, 38), (1413, 2320, 43, 29)], [(142, 173, 532, 2046), (694, 191, 546, 2055), (1242, 344, 304, 1383)]),
    ('vertical', 1672, 2438, [(139, 214, 490, 71), (141, 319, 143, 47), (139, 382, 494, 73), (1011, 59, 38, 38), (1083, 70, 24, 13), (1016, 117, 140, 19), (1142, 51, 366, 86), (688, 207, 499, 243), (1243, 329, 68, 19), (1242, 358, 270, 108), (509, 531, 308, 63), (141, 681, 493, 72), (142, 767, 491, 69), (144, 871, 320, 48), (690, 666, 177, 39), (691, 719, 495, 200), (691, 967, 287, 36), (141, 936, 492, 70), (141, 1021, 494, 71), (143, 1139, 193, 37), (692, 1016, 496, 158), (142, 1191, 496, 155), (1242, 976, 267, 229), (788, 1290, 623, 59), (142, 1366, 127, 22), (144, 1403, 495, 113), (143, 1564, 191, 35), (143, 1616, 496, 366), (144, 2029, 143, 35), (145, 2081, 491, 112), (713, 1872, 10, 7), (734, 1426, 355, 92), (733, 1567, 359, 587), (738, 2168, 348, 20), (1120, 1423, 359, 730), (1014, 2322, 292, 31), (1384, 2322, 63, 26)], [(118, 193, 541, 281), (672, 191, 533, 289), (492, 517, 347, 91), (116, 669, 545, 1549), (678, 653, 519, 551), (1218, 305, 315, 928), (778, 1282, 653, 84), (721, 1421, 376, 779), (1111, 1416, 376, 760)]),
    ('vertical', 1675, 2435, [(1025, 54, 483, 49), (1023, 117, 490, 19), (149, 188, 241, 48), (721, 212, 317, 24), (140, 255, 499, 71), (174, 468, 290, 27), (147, 510, 494, 69), (146, 597, 503, 67), (146, 677, 503, 157), (172, 849, 472, 70), (525, 922, 45, 13), (147, 933, 502, 72), (172, 1019, 373, 70), (147, 1145, 497, 72), (152, 1231, 469, 29), (699, 358, 503, 516), (697, 935, 241, 25), (699, 974, 495, 241), (1249, 241, 262, 137), (1249, 419, 55, 19), (1249, 449, 271, 135), (1253, 626, 100, 17), (1251, 656, 269, 77), (1251, 774, 123, 18), (1251, 801, 263, 80), (1253, 922, 102, 16), (1250, 951, 269, 105), (1250, 1099, 106, 46), (206, 1340, 527, 58), (204, 1432, 598, 56), (872, 1336, 332, 119), (221, 1592, 327, 38), (196, 1667, 599, 199), (904, 1593, 328, 35), (879, 1664, 597, 199), (221, 1933, 327, 35), (197, 2007, 595, 168), (904, 1929, 327, 38), (879, 2005, 599, 169), (1019, 2321, 290, 32), (1255, 2316, 192, 38)], [(126, 175, 534, 1107), (686, 187, 531, 1047), (1234, 202, 304, 967), (186, 1332, 654, 178), (177, 1575, 633, 307), (858, 1324, 360, 160), (857, 1575, 638, 295), (185, 1914, 616, 280), (863, 1913, 632, 287)]),
    ('vertical', 1672, 2435, [(141, 200, 435, 82), (141, 288, 103, 35), (170, 342, 308, 24), (142, 382, 495, 112), (141, 512, 476, 65), (140, 595, 496, 492), (140, 1104, 165, 26), (140, 1149, 504, 703), (140, 1869, 231, 66), (139, 1951, 487, 155), (167, 2121, 470, 27), (142, 2166, 282, 23), (1018, 55, 489, 83), (691, 197, 505, 849), (692, 1062, 280, 67), (690, 1146, 295, 69), (833, 1233, 260, 65), (690, 1314, 226, 28), (690, 1355, 495, 241), (988, 1682, 217, 71), (1242, 392, 263, 105), (1241, 537, 273, 256), (1242, 830, 266, 198), (1242, 1070, 264, 106), (1243, 1216, 263, 167), (1114, 1799, 349, 409), (1377, 2321, 53, 28)], [(123, 166, 537, 2058), (680, 178, 525, 1452), (1234, 364, 283, 1071), (981, 1697, 239, 65), (1104, 1791, 376, 425)]),
    ('vertical', 1675, 2438, [(1024, 63, 489, 84), (149, 218, 134, 25), (149, 259, 372, 29), (696, 220, 139, 22), (844, 262, 122, 26), (146, 304, 93, 21), (699, 304, 22, 24), (146, 346, 495, 65), (822, 303, 315, 69), (696, 385, 401, 74), (722, 473, 322, 27), (144, 429, 207, 25), (146, 473, 492, 195), (143, 672, 105, 37), (144, 728, 494, 67), (577, 788, 7, 7), (145, 839, 487, 85), (168, 930, 103, 36), (143, 983, 496, 67), (142, 1068, 92, 23), (145, 1111, 491, 67), (696, 516, 93, 25), (722, 561, 227, 22), (693, 602, 497, 323), (693, 975, 136, 74), (824, 941, 192, 26), (696, 1068, 427, 154), (1248, 221, 271, 169), (1247, 429, 264, 225), (1245, 723, 270, 168), (400, 1327, 842, 56), (177, 1443, 412, 311), (189, 1800, 105, 23), (176, 1838, 404, 92), (175, 1973, 406, 240), (620, 1451, 406, 162), (618, 1657, 408, 415), (648, 2117, 122, 25), (619, 2158, 403, 56), (1061, 1451, 408, 272), (1060, 1764, 408, 452), (1374, 2332, 61, 27)], [(129, 189, 534, 1032), (685, 198, 513, 1043), (1233, 204, 296, 707), (391, 1312, 867, 99), (165, 1433, 431, 795), (609, 1438, 427, 807), (1053, 1444, 430, 785)]),
    ('horizontal', 1698, 2492, [(347, 238, 11, 3), (395, 234, 11, 7), (511, 236, 11, 5), (584, 235, 11, 6), (818, 208, 698, 23), (505, 368, 935, 853), (356, 405, 49, 342), (219, 370, 91, 844), (1425, 1328, 31, 103), (906, 1325, 50, 109), (597, 1377, 15, 62), (563, 1324, 35, 142), (1023, 1326, 381, 860), (677, 1328, 207, 847), (332, 1326, 208, 847), (1525, 2335, 48, 49)], [(190, 322, 1276, 936), (316, 1317, 1180, 883)]),
    ('horizontal', 1698, 2484, [(825, 207, 698, 24), (1631, 239, 10, 3), (1678, 237, 11, 6), (1433, 372, 36, 217), (856, 368, 35, 143), (605, 370, 12, 138), (567, 368, 41, 138), (1315, 410, 38, 328), (1081, 373, 224, 1801), (971, 405, 36, 795), (685, 369, 149, 1805), (223, 368, 326, 1804), (1534, 2336, 45, 47)], [(202, 343, 1300, 1861)]),
    ('horizontal', 1698, 2488, [(820, 206, 698, 23), (1378, 369, 20, 28), (228, 367, 26, 121), (1369, 368, 98, 1798), (1311, 382, 36, 498), (1254, 372, 37, 1497), (1195, 368, 37, 527), (907, 367, 272, 1805), (851, 371, 39, 1796), (392, 366, 438, 1376), (333, 367, 38, 420), (276, 370, 39, 1372), (282, 2184, 149, 32), (1530, 2332, 46, 47)], [(616, 356, 883, 1877), (193, 350, 370, 1422)]),
    ('horizontal', 1698, 2488, [(182, 202, 585, 29), (1496, 410, 40, 451), (1433, 368, 44, 1807), (1264, 367, 154, 582), (1155, 402, 34, 153), (1041, 401, 32, 155), (924, 401, 35, 156), (845, 533, 11, 52), (1095, 404, 36, 825), (980, 403, 35, 755), (866, 402, 35, 685), (460, 365, 399, 1803), (164, 550, 70, 1617), (115, 2332, 43, 44)], [(436, 326, 1129, 1874), (142, 536, 118, 1664)]),
    ('horizontal', 1698, 2492, [(180, 207, 604, 30), (1380, 369, 154, 541), (923, 365, 450, 1807), (807, 369, 38, 666), (691, 368, 96, 1804), (521, 368, 148, 1236), (406, 404, 34, 1358), (164, 558, 30, 1017), (125, 2337, 43, 44)], [(370, 349, 1195, 1848), (136, 538, 88, 1071)]),
    ('horizontal', 1698, 2484, [(179, 204, 607, 29), (1438, 365, 96, 615), (1380, 398, 38, 351), (1034, 365, 329, 1801), (922, 367, 36, 1251), (864, 364, 36, 598), (461, 364, 386, 1806), (405, 366, 35, 474), (165, 553, 71, 1604), (124, 2335, 45, 46)], [(388, 349, 1180, 1843), (151, 532, 106, 1657)]),
    ('horizontal', 1694, 2488, [(180, 203, 604, 29), (1496, 368, 38, 1551), (1381, 384, 38, 347), (1265, 364, 95, 1430), (1210, 367, 35, 438), (1095, 365, 93, 1042), (980, 365, 91, 456), (461, 363, 498, 890), (408, 368, 31, 400), (348, 366, 34, 885), (431, 1312, 451, 54), (163, 551, 30, 967), (628, 1540, 52, 25), (443, 1656, 77, 35), (759, 1757, 54, 23), (495, 1757, 52, 25), (122, 2334, 43, 42), (627, 1951, 54, 25)], [(976, 344, 583, 1593), (338, 349, 637, 915), (148, 536, 67, 1003)]),
    ('horizontal', 1694, 2484, [(182, 202, 584, 30), (1501, 365, 34, 379), (1269, 362, 128, 463), (1211, 398, 33, 496), (1129, 1852, 12, 138), (978, 365, 155, 1801), (901, 1531, 10, 40), (809, 363, 92, 1804), (752, 363, 34, 300), (692, 367, 38, 1376), (580, 363, 94, 372), (163, 550, 157, 1619), (121, 2330, 46, 49), (488, 2182, 225, 33), (1444, 1809, 30, 175), (1442, 2101, 30, 65)], [(807, 327, 754, 1871), (565, 352, 245, 1411), (151, 536, 185, 1663)]),
    ('horizontal', 1686, 2488, [(116, 2330, 44, 44), (181, 200, 606, 29), (1376, 364, 154, 1502), (1359, 1173, 9, 34), (972, 363, 389, 1660), (572, 364, 329, 1380), (159, 548, 241, 1620), (608, 2178, 76, 35), (964, 2181, 178, 32)], [(1252, 341, 292, 1736), (534, 338, 725, 1421), (145, 538, 275, 1677)]),
    ('horizontal', 1674, 2484, [(168, 207, 622, 31), (967, 360, 564, 1805), (910, 368, 39, 880), (854, 367, 35, 365), (682, 365, 98, 390), (335, 367, 326, 889), (397, 1301, 535, 58), (524, 1496, 95, 44), (617, 1456, 82, 22), (695, 1497, 92, 40), (607, 1606, 124, 145), (154, 557, 34, 1361), (671, 1822, 72, 17), (446, 2115, 83, 26), (120, 2336, 43, 43)], [(1020, 343, 526, 1861), (320, 350, 699, 915), (139, 546, 64, 1393)]),
]
