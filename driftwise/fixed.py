"""Names and formats that stored data has."""

# They must be as the data has them.

#: Types of mismatches.
COLLECTION_MISMATCH = "COLLECTION_MISMATCH"
AMBIGUOUS_CV = "AMBIGUOUS_CV"
MISSING = "MISSING"
CV_MISMATCH = "CV_MISMATCH"

#: Decisions about mismatches.
PLANNED = "PatchPlannedDryRun"
SKIPPED_AMBIGUOUS = "SkippedAmbiguousCv"
SKIPPED_COLLECTION = "SkippedCollectionMismatch"

ALREADY_PLANNED = "SkippedAlreadyPlanned"
STATE_CHANGED = "SkippedStateChanged"
ALREADY_CONSISTENT = "SkippedAlreadyConsistent"
BY_OPERATOR = "SkippedByOperator"
PATCHED = "PatchCompletedOnWinner"
PATCH_FAILED = "PatchFailed"

#: States of an execution that are no end: sent, with and without a known operation.
DISPATCHING, STARTED = "PatchDispatching", "PatchStarted"

#: What a patch reports of a document that it changed, and of one that isn't there.
DETAIL_PATCHED, DETAIL_ABSENT = "Patched", "DocumentDoesNotExist"

#: Reasons why a plan no longer holds.
CONSISTENT_NOW, STILL_INCONSISTENT = "ConsistentNow", "ChangedStillInconsistent"

#: Run modes and phases.
LIVE_SCAN, APPLY, IMPORT, DOWNLOAD, CACHED_IMPORT = "LiveETagScan", "ApplyRepairPlan", "ImportSnapshots", "DownloadSnapshotsToCache", "ImportCachedSnapshotsToStateStore"
SCAN_ONLY, DRY_RUN, SCAN_AND_REPAIR, CROSS_CHECK, FIXUP = "ScanOnly", "DryRunRepair", "ScanAndRepair", "SnapshotCrossCheck", "MismatchDecisionFixup"
PHASE_DOWNLOAD, PHASE_IMPORT, PHASE_INDEX, PHASE_CANDIDATES = "SnapshotCacheDownload", "SnapshotImport", "WaitingForSnapshotIndex", "CandidateProcessing"
FIRST_MISMATCH = "FirstMismatch"

#: What a node is to do next.
START_SCAN, RESUME_SCAN, START_APPLY, RESUME_APPLY = "StartScan", "ResumeScan", "StartApply", "ResumeApply"

#: Types and flags of feed items, in upper case.
DOCUMENT, TOMBSTONE = "DOCUMENT", "TOMBSTONE"
CONFLICTED, DELETE_REVISION = "CONFLICTED", "DELETEREVISION"

#: Reasons why an id is unsafe, and the beginning of the physical ids that stand for unsafe ones.
BACKSLASH, CONTROL, SAFE = "ContainsBackslash", "ContainsControlCharacter", "None"
DIGEST_PREFIX = "NodeDocumentSnapshots/"

#: The statement that rewrites documents unchanged, around the name of the collection.
TOUCH_BEFORE, TOUCH_AFTER = 'from "', '" where id() in ($ids) update { put(id(this), this); }'
