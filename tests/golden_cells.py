"""Golden contingency: 90 (cluster, category, count) cells of a published 76-cluster run.

Fixed values (published result data), sorted by cluster then category.
Expected: purity 0.8981481481, NMI 0.8591196419, ARI 0.5997543239,
mean categories per cluster 1.1842105263, 4,536 rows, 34 categories.
"""

CELLS = [
    (0, 'Chassis Components', 5),
    (0, 'Notebook Parts & Accessories', 16),
    (1, 'Flat Panel Spare Parts', 1),
    (1, 'Notebook Parts & Accessories', 94),
    (2, 'Notebook Parts & Accessories', 61),
    (3, 'Notebook Parts & Accessories', 20),
    (4, 'Notebook Parts & Accessories', 36),
    (5, 'Notebook Parts & Accessories', 39),
    (6, 'Flat Panel Spare Parts', 218),
    (6, 'Notebook Parts & Accessories', 9),
    (7, 'Notebook Parts & Accessories', 14),
    (8, 'Warranty & Support Extensions', 161),
    (9, 'Warranty & Support Extensions', 47),
    (10, 'Warranty & Support Extensions', 18),
    (11, 'All-in-One PCs/Workstations', 344),
    (11, 'Notebooks', 357),
    (11, 'PCs/Workstations', 1),
    (12, 'All-in-One PCs/Workstations', 101),
    (12, 'Notebooks', 89),
    (13, 'System Components', 16),
    (14, 'Power Adapters & Inverters', 142),
    (15, 'Power Adapters & Inverters', 21),
    (16, 'Power Adapters & Inverters', 23),
    (17, 'Smartphones', 16),
    (18, 'Smartphones', 16),
    (19, 'Keyboards', 39),
    (20, 'Keyboards', 28),
    (21, 'Keyboards', 22),
    (22, 'Keyboards', 15),
    (23, 'Data Storage Devices', 22),
    (24, 'Data Storage Devices', 15),
    (25, 'PCs/Workstations', 137),
    (26, 'PCs/Workstations', 91),
    (27, 'PCs/Workstations', 27),
    (27, 'Tablets', 2),
    (28, 'PCs/Workstations', 23),
    (29, 'PCs/Workstations', 33),
    (30, 'PCs/Workstations', 33),
    (31, 'PCs/Workstations', 49),
    (32, 'Print & Scan Accessories', 25),
    (33, 'Print & Scan Accessories', 59),
    (34, 'Print & Scan Accessories', 24),
    (35, 'Print & Scan Accessories', 17),
    (36, 'Data Projectors', 15),
    (37, 'Household Batteries', 17),
    (38, 'Tablets', 19),
    (39, 'Display Privacy Filters', 21),
    (40, 'TVs', 327),
    (41, 'TVs', 40),
    (42, 'Computer Monitors', 72),
    (42, 'Signage Displays', 1),
    (42, 'TVs', 1),
    (43, 'Antivirus Security Software', 146),
    (43, 'Software Licenses/Upgrades', 3),
    (44, 'Antivirus Security Software', 45),
    (45, 'Antivirus Security Software', 13),
    (45, 'Software Licenses/Upgrades', 3),
    (46, 'Antivirus Security Software', 1),
    (46, 'Software Licenses/Upgrades', 113),
    (47, 'Software Licenses/Upgrades', 28),
    (48, 'Software Licenses/Upgrades', 26),
    (49, 'Software Licenses/Upgrades', 16),
    (50, 'Printing Supplies', 28),
    (51, 'Printing Supplies', 23),
    (52, 'Printing Supplies', 29),
    (53, 'Cameras & Camcorders', 24),
    (54, 'Printing Equipment', 56),
    (55, 'Printing Equipment', 16),
    (56, 'Computer Monitors', 76),
    (57, 'Computer Monitors', 21),
    (58, 'Screen Protectors', 24),
    (59, 'Screen Protectors', 33),
    (60, 'Screen Protectors', 22),
    (61, 'Screen Protectors', 33),
    (62, 'Fibre Optic Cables', 124),
    (63, 'Fibre Optic Cables', 23),
    (64, 'Mobile Phone Cases', 18),
    (65, 'Networking Cables', 82),
    (66, 'Networking Cables', 18),
    (67, 'Networking Cables', 19),
    (68, 'Projection Screens', 92),
    (69, 'Projection Screens', 74),
    (70, 'Mobile Phone Spare Parts', 29),
    (71, 'Uninterruptible Power Supplies (UPSs)', 58),
    (72, 'Uninterruptible Power Supplies (UPSs)', 32),
    (73, 'Servers', 53),
    (73, 'System Components', 1),
    (74, 'Signage Displays', 48),
    (75, 'Server Barebones', 46),
    (75, 'System Components', 1),
]
