"""Constants of the physical model and names of keys (fixed values)."""

PHI_0, PHI_C, H_MAX = 0.4, 0.90, 1.2
SEGDIST_DENSE, SEGDIST_SPARSE = 2.05, 3.4
S_LOCAL_BACKGROUND = 0.338
#: Spacing of the disks that stand for a rod.
DISK_SPACING = 0.1

SIM = ["ensemble_id", "replica"]
KEY = [*SIM, "idx"]
